"""A stored index: segments, replaced and deleted documents, merging, pruned reads, ranks equal to a plain computation."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventloom.operators import search, segments

WORDS = ["alpha", "alphabet", "beta", "bet", "gamma", "gam", "delta", "deltas", "élan", "omega", "zeta", "漢字", "12", "123"]


def texts(seed, n):
    rng = random.Random(seed)
    return {f"d{k:03d}": " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))) for k in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "event_id string, text string")


def ranked(docs, questions, limit=50):
    """BM25 over whole documents, every word of a question a required prefix."""
    bags = {k: Counter(t.replace("é", "e").split()) for k, t in docs.items()}
    n, mean = len(docs), sum(sum(b.values()) for b in bags.values()) / len(docs)
    out = []
    for qid, q in questions:
        scores = {k: 0.0 for k in bags} if q.split() else {}
        for prefix in q.replace("é", "e").split():
            tf = {k: sum(c for w, c in b.items() if w.startswith(prefix)) for k, b in bags.items()}
            df = sum(v > 0 for v in tf.values())
            raw = math.log((n - df + 0.5) / (df + 0.5)) if df <= n else 0
            idf = raw if raw > 0 else 1e-6
            scores = {k: s + idf * tf[k] * 2.2 / (tf[k] + 1.2 * (0.25 + 0.75 * sum(bags[k].values()) / mean)) for k, s in scores.items() if tf[k]}
        best = sorted((-round(s, 6), k) for k, s in scores.items())[:limit]
        out += [(qid, k, -s, place) for place, (s, k) in enumerate(best, 1)]
    return out


QUESTIONS = [(1, "alph"), (2, "bet alph"), (3, "gamma delta z"), (4, "a b g d o"), (5, "nothing"), (6, ""), (7, "alph alph 1"), (8, "él 漢"), (9, "alpha nothing")]


def same(got, want):
    got, want = sorted(got, key=lambda r: (r[0], r[3])), sorted(want, key=lambda r: (r[0], r[3]))
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def rows(df):
    return [(r["qid"], r["id"], r["score"], r["rank"]) for r in df.collect()]


def test_segments_deletes_merges_and_ranks(spark, tmp_path):
    root, docs = str(tmp_path / "index"), texts(1, 60)
    asked = spark.createDataFrame(QUESTIONS, "qid long, q string")
    segments.add(frame(spark, {k: t for k, t in docs.items() if k < "d030"}), root)
    segments.add(frame(spark, {k: t for k, t in docs.items() if k >= "d030"}), root)
    index = segments.open_index(spark, root)
    assert len(index.segments) == 2
    same(rows(index.search(asked)), ranked(docs, QUESTIONS))
    same(rows(index.search(asked, limit=3)), ranked(docs, QUESTIONS, 3))

    changed = {"d001": "alpha alpha zeta", "d040": "beta new", "d900": "gamma delta zeta"}
    segments.add(frame(spark, changed), root)  # replaces what has these ids
    segments.delete(spark.createDataFrame([("d002",), ("d041",), ("d777",)], "event_id string"), root)
    docs = {k: t for k, t in {**docs, **changed}.items() if k not in ("d002", "d041")}
    want = Counter(w for t in docs.values() for w in set(t.replace("é", "e").split()))
    for most in (None, 2, 1):
        if most:
            assert len(segments.merge_segments(spark, root, most)) == most
        index = segments.open_index(spark, root)
        assert {r["term"]: r["df"] for r in index.terms().collect()} == dict(want)
        assert index.documents().count() == len(docs)
        same(rows(index.search(asked)), ranked(docs, QUESTIONS))
    assert index.marks == [] and len(segments.whole_folders(spark, f"{root}/postings", any_state=True)) <= 2

    segments.add(frame(spark, {"d002": "back again"}), root)  # a deleted id may come back
    assert segments.open_index(spark, root).documents().where("id = 'd002'").count() == 1


def test_reads_are_pruned(spark, tmp_path):
    root = str(tmp_path / "index")
    segments.add(frame(spark, texts(2, 30)), root)
    plan = segments.open_index(spark, root).postings([3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_broken_write_is_not_seen(spark, tmp_path, monkeypatch):
    root, docs = str(tmp_path / "index"), texts(3, 20)
    segments.add(frame(spark, docs), root)

    def broken(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(segments, "_publish", broken)
    with pytest.raises(RuntimeError):
        segments.add(frame(spark, {"x": "alpha"}), root)
    monkeypatch.undo()
    assert segments.open_index(spark, root).documents().count() == 20
    segments.add(frame(spark, {"x": "alpha"}), root)
    assert segments.open_index(spark, root).documents().count() == 21
    segments.add(spark.createDataFrame([], "event_id string, text string"), root)
    assert segments.open_index(spark, root).documents().count() == 21


def test_search_needs_no_stored_index(spark):
    docs = texts(4, 40)
    df = frame(spark, docs)
    got = search.search(search.build_index(df, fields=("text",)), search.corpus(df, fields=("text",)), spark.createDataFrame(QUESTIONS, "qid long, q string"))
    same(rows(got), ranked(docs, QUESTIONS))
    assert search.corpus(df.where(F.lit(False)), fields=("text",)).first()["n_docs"] == 0


def test_repeated_ids_are_added_up_and_only_ids_held_before_are_marked(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = [(1, "b a b"), (1, "b b c"), (1, "a"), (None, "a b"), (None, "b a"), (2, None), (3, "")]
    segments.add(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), root, "doc_id", ("text",))
    index = segments.open_index(spark, root)
    got = sorted((r["term"], r["id"] or 0, r["tf"], r["dl"]) for r in index.postings().collect())
    assert got == [("a", 0, 2, 2), ("a", 1, 1, 1), ("a", 1, 1, 3), ("b", 0, 2, 2), ("b", 1, 4, 3), ("c", 1, 1, 3)]
    assert sorted((r["id"] or 0, r["dl"]) for r in index.documents().collect()) == [(0, 2), (1, 1), (1, 3), (2, 0), (3, 0)]
    segments.add(spark.createDataFrame([(3, "x y"), (4, "x"), (5, "y")], "doc_id long, text string"), root, "doc_id", ("text",))
    assert [r["id"] for r in spark.read.parquet(f"{root}/deletes/mark=2").collect()] == [3]
    assert sorted(r["id"] for r in segments.open_index(spark, root).documents().where("id > 1").collect()) == [2, 3, 4, 5]


def test_words_are_cut_on_all_cores_and_common_hits_stay_where_they_are(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('common word', CAST(id AS STRING), ' ', repeat('common ', 3)) AS text").coalesce(1)
    segments.add(docs, root, "doc_id", ("text",))
    hits = segments.open_index(spark, root).search(spark.createDataFrame([(1, "common word7"), (2, "word12 com"), (3, "none common")], "qid int, q string"))
    got = {(r["qid"], r["id"]) for r in hits.collect()}
    assert got == {(1, i) for i in (7, *range(70, 80))} | {(2, i) for i in (12, *range(120, 130))}
    # a bitmap of what was found stands before the join with the hits
    assert "bit_or" in hits._jdf.queryExecution().optimizedPlan().toString()
