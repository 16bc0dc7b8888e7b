"""Cases of the second review: many rows that share an id."""

from collections import defaultdict

from pyspark.sql import functions as F

from eventloom.llm import linededup, simhash


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_drops_of_a_row_are_its_own(spark):
    common = [f"a line that several documents hold {k}" for k in range(9)]
    rows = [(5, f"{common[k]}\nown text of row {k}") for k in range(9)] + [(5, f"{common[0]}\nown text of row 0")]
    rows += [(i, "\n".join(common)) for i in (1, 2, 9)]
    got = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in got.collect()) == sorted(
        [(5, f"own text of row {k}", 1) for k in (0, *range(9))] + [(i, "", 9) for i in (1, 2)] + [(9, "\n".join(common), 0)])
    gathered = [x for x in plan_of(got).splitlines() if "collect_list" in x]
    assert gathered and all("row" in x for x in gathered)  # lists are gathered by (id, row), not by id


def test_fingerprints_of_an_id_are_not_gathered(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("gathers all fingerprints of an id")
    monkeypatch.setattr(F, "collect_set", refused)
    rows = [(7, f"text number {k} with words of its own {k * k}") for k in range(20)] + [(3, "text number 4 with words of its own 16"), (8, "other words")]
    got = defaultdict(set)
    for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert got == {7: {3}, 3: {3}, 8: {8}}
