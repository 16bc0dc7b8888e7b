"""Results and plans that must hold as tables grow."""

import difflib
import random
from datetime import datetime

from pyspark.sql import functions as F

from eventloom.functions.text import RECOVERED_DEFAULT
from eventloom.operators import keyed
from eventloom.operators import resolve as R
from eventloom.operators.intents import apply_intents, parse_questions
from eventloom.operators.score import weighted_keywords
from eventloom.plans import jobs
from eventloom.schema import event_frame
from eventloom.session import cut_lineage


def test_weighted_keywords_leave_the_words_where_they_are(spark):
    texts = spark.createDataFrame([(1, "The cat sat with the dog"), (1, "The cat sat with the dog"), (2, "cats with-out"), (None, "open job fair"), (3, None)],
                                  "doc_id long, text string")
    weights = spark.createDataFrame([("The", 1.5), ("with", 2.0), ("job fair", 3.0), ("open fair", 9.0), ("with the", 0.25), ("!", 5.0)], "term string, weight double")
    got = {tuple(r) for r in weighted_keywords(texts, "doc_id", "text", weights).collect()}
    assert got == {(1, 7.5, 6), (2, 2.0, 1), (None, 3.0, 1)}
    single = weighted_keywords(texts, "doc_id", "text", weights.where("term IN ('The', 'with')"))
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {tuple(r) for r in single.collect()} == {(1, 7.0, 4), (2, 2.0, 1)}


def test_questions_are_counted_before_they_meet_events(spark):
    events = event_frame(spark, [
        {"event_id": "a", "title": "AI Hackathon", "city": "Tanta", "ticket_type": "Free"},
        {"event_id": "a", "title": "AI Hackathon", "city": "Tanta", "ticket_type": "Free"},
        {"event_id": "b", "title": "Job Expo", "category": "Career Fair", "priority": "HIGH", "date_display": "Oct 3", "ticket_type": "9 EGP"}])
    rows = [(1, "free hackathons in Tanta", "x"), (2, "free hackathons in Tanta", "x"), (3, "free hackathons in Tanta", None),
            (4, "top career fairs in october", "x"), (5, "hi", "x"), (6, None, "x")]
    asked = parse_questions(spark.createDataFrame(rows, "qid long, q string, kind string"))
    assert asked.columns == ["qid", "q", "kind", "intent"] and asked.count() == 6
    assert {r.qid for r in asked.where("intent IS NULL").collect()} == {5, 6}
    pairs = apply_intents(events, asked)
    want = {tuple(r) for r in pairs.join(asked.select("qid", "kind"), "qid").groupBy("kind", "event_id").agg(F.count("*").alias("n")).collect()}
    counted = apply_intents(events, asked, count_by=["kind"])
    assert counted.columns == ["kind", "event_id", "n"]
    assert {tuple(r) for r in counted.collect()} == want == {("x", "a", 4), (None, "a", 2), ("x", "b", 1)}


def test_pairs_are_ruled_out_by_fine_counts_and_none_is_lost(spark):
    rng = random.Random(3)
    alphabet = "abcdef0123456789 ghimnoprstuكتبل😀_"
    titles = ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 90))).strip() or "abc" for _ in range(150)]
    changed = []
    for t in titles:
        c = list(t)
        for _ in range(max(1, len(c) // 14)):
            at = rng.randrange(len(c))
            c[at:at + rng.randint(0, 1)] = rng.choice(alphabet)
        changed.append("".join(c))
    # equal in the coarse classes, far apart in single digits
    alike = ("00000 55555 00000 55555", "44444 99999 33333 66666")
    pairs = sorted({*zip(titles, changed), alike})
    keys = R.title_keys(spark.createDataFrame(sorted({(x,) for p in pairs for x in p}), "fuzzy string"))
    rows = keys.withColumns({"size": F.col("n_chars"), "kind": F.lit("R")})
    old = rows.withColumns({n: F.lit(None).cast("long") for n in (*R.BAG, *R.FINE)})  # stored before these counts were kept

    def near(right):
        both = spark.createDataFrame(pairs, "a string, b string").join(rows.alias("l"), F.col("a") == F.col("l.fuzzy")).join(right.alias("r"), F.col("b") == F.col("r.fuzzy"))
        return {(r.a, r.b): r.n for r in both.select("a", "b", R._near("l", "r").alias("n")).collect()}

    got = near(rows)
    assert got[alike] is False and near(old)[alike] is True
    similar = [p for p in pairs if difflib.SequenceMatcher(None, *p).ratio() >= 0.85]
    assert len(similar) > 100 and all(got[p] for p in similar)


def test_trigrams_of_a_title(spark):
    rows = spark.createDataFrame([("ab😀é",), ("x",)], "t string").select(R._grams(F.col("t")).alias("g")).collect()
    assert [r.g for r in rows] == [["\x02ab", "ab😀", "b😀é", "😀é\x03"], ["\x02x\x03"]]


def test_lookups_in_large_tables_spread_hot_keys_and_are_not_broadcast_unmeasured(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(keyed, "HOT_ROWS", 3)
    rows = spark.createDataFrame([*((i, "hot") for i in range(9)), (20, "a"), (21, "b"), (22, None), (23, None), (24, "lost")], "i long, k string")
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("unasked", 4)], "k string, v int")
    want = {*((i, "hot", 1) for i in range(9)), (20, "a", 2), (21, "b", 3), (22, None, None), (23, None, None), (24, "lost", None)}
    assert sorted(map(str, (tuple(r) for r in keyed.counted_lookup(rows, table, ["k"]).select("i", "k", "v").collect()))) == sorted(map(str, want))
    left = keyed.anti_by_any(rows.withColumn("j", F.col("i").cast("string")), table.withColumn("w", F.lit("24")), {"k": "k", "j": "w"}).select("i").collect()
    assert sorted(r.i for r in left) == [22, 23]
    # files of equal values are small however many rows they hold
    spark.range(2_000_000).select(F.col("id"), F.lit("same").alias("v")).write.parquet(f"{tmp_path}/t")
    big = spark.read.parquet(f"{tmp_path}/t")
    from_files = keyed.salted_lookup(big.withColumnRenamed("v", "own"), big.where("id % 2 = 0"), ["id"])
    plan = from_files._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    assert from_files.where("v IS NULL").count() == 1_000_000


def test_candidates_are_not_broadcast_by_the_size_of_their_files(spark):
    base = R.signature_base(event_frame(spark, [{"event_id": str(i), "title": f"meeting of makers {i}", "url": f"https://x.org/{i}"} for i in range(5)]).withColumn(
        "seq", F.monotonically_increasing_id()))
    sigs = base.select("sid", "norm", "fuzzy", "at")
    keys = R.title_keys(base)
    plan = R._candidates(R._blocks(sigs, keys), R._blocks(sigs, keys))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and "kind" not in "".join(line for line in plan.splitlines() if "BroadcastHashJoin" in line)


def test_filters_do_not_repeat_the_recovery_of_a_title(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(jobs, "cut_lineage", seen)
    rows = event_frame(spark, [{"event_id": "a", "title": "Delta Makers Meeting", "url": "https://x.org/a", "city": "Tanta"},
                               {"event_id": "b", "title": "Null", "url": "", "city": "Tanta"}]).withColumn("seq", F.monotonically_increasing_id())
    jobs.deduplicate_client(rows, datetime(2023, 6, 15))
    filters = [line for p in plans for line in p.splitlines() if "Filter " in line]
    assert filters and any(RECOVERED_DEFAULT in p for p in plans) and not any(RECOVERED_DEFAULT in line for line in filters)
