"""Containment joins against comparing every pair."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import contains, enrich, keyed, views
from eventloom.schema import event_frame


def made(seed, n, longest, alphabet="ab c漢é😀"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("seed,longest", [(1, 9), (2, 4), (3, 1)])
def test_all_pairs(spark, seed, longest):
    texts = [*made(seed, 60, 40), None, "", "x" * 20_000 + "ab c", "twice", "twice"]
    keys = [*made(seed + 10, 50, longest), None, "", "b", "b", "not there", "wice", "xxxxxx", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    asked = spark.createDataFrame(list(enumerate(keys)), "m int, key string")
    got = sorted((r["n"], r["m"]) for r in contains.search_many(rows, F.col("text"), asked, F.col("key")).select("n", "m").collect())
    assert got == sorted((n, m) for n, t in enumerate(texts) for m, k in enumerate(keys) if t is not None and k and k in t)


def test_no_nested_loop_and_empty_sides(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, "two")], "n int, text string")
    keys = spark.createDataFrame([(1, "two"), (2, "ne t")], "m int, key string")
    found = contains.search_many(rows, F.col("text"), keys, F.col("key"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 3
    assert contains.search_many(rows, F.col("text"), keys.where("false"), F.col("key")).count() == 0
    assert contains.search_many(rows.where("false"), F.col("text"), keys, F.col("key")).count() == 0


def test_first_entry_wins(spark):
    directory = spark.createDataFrame([(3, "club", "c@x"), (1, "robot", "r@x"), (2, "club", "d@x"), (0, "", "e@x"), (4, None, "f@x")], "ord int, key string, email string")
    texts = spark.createDataFrame([("robot club",), ("club night",), ("robot club",), ("nothing",), (None,)], "text string")
    got = {r["email"] for r in contains.first_contained(texts, directory).collect()}
    assert got == {"r@x", "d@x"} and contains.first_contained(texts, directory).count() == 2


def test_enrichment_from_a_frame_equals_that_from_a_list(spark):
    entries = [("robotics", "r@x.org", "rob", None, "010 1"), ("career", "c@x.org", None, "company/c", None), ("night", None, "n", None, "012 2")]
    table = spark.createDataFrame([(i, *e, f"Name {e[0]}") for i, e in enumerate(entries)],
                                  "ord int, key string, email string, instagram string, linkedin string, phone string, name string")
    events = event_frame(spark, [dict(event_id=f"e{i}", title=t, description=d, organizer=o, url=f"https://x.org/{i}") for i, (t, d, o) in enumerate([
        ("Career Night", "mail me@z.org", "Robotics"), ("Night walk", "", ""), ("Open day", "career", "X"), ("Plain", "call 01012345678", "Y"), ("Night walk", "", "")])])
    columns = ["event_id", "organizer", "organizer_email", "organizer_instagram", "organizer_linkedin", "organizer_phone"]
    for f, more in ((enrich.enrich_contacts, {}), (enrich.enrich_client, {"names": [(e[0], f"Name {e[0]}") for e in entries]})):
        want = f(events, entries, **more).select(columns).collect()
        assert sorted(map(str, f(events, table).select(columns).collect())) == sorted(map(str, want))


def test_keyword_questions(spark):
    events = event_frame(spark, [dict(event_id=f"e{i}", title=t, location=p) for i, (t, p) in enumerate([("AI Night", "Hall A"), ("Fair", "Night Hall"), ("Talk", "x")])])
    asked = spark.createDataFrame([(1, " night "), (2, "hall"), (3, "night hall"), (4, ""), (5, "tal\x00k")], "qid int, q string")
    got = {(r["qid"], r["event_id"]) for r in views.keyword_many(events, asked).collect()}
    assert got == {(1, "e0"), (1, "e1"), (2, "e0"), (2, "e1"), (3, "e1")}
    for qid, q in ((1, "night"), (2, "hall"), (3, "night hall")):
        assert {e for k, e in got if k == qid} == {r["event_id"] for r in events.where(views.keyword(q)).collect()}


def test_grams_that_no_key_has_stay_where_they_are(spark, tmp_path):
    """Texts are cut in the thousands of grams; only the few that a key asks for are sorted and joined."""
    texts = [f"{i:06d} " + "".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(400)) for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    asked = spark.createDataFrame([(m, f"{m:06d}") for m in range(40)], "m int, key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = contains.search_many(rows, F.col("text"), asked, F.col("key")).select("n", "m")
        assert sorted(map(tuple, found.collect())) == [(m, m) for m in range(40)]
        grams = contains._by_grams(rows.withColumn("t", F.md5("text")), [6], "text", ("t",))
        some = asked.select(F.xxhash64(F.lit(6), "key").alias("h"))
        kept = grams.where(keyed.marked(F.col("h"), some))
        assert grams.count() > 100_000 and 40 <= kept.count() < 400 and kept.join(some, "h").count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_bitmap_marks_every_hash(spark):
    some = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    other = spark.range(20_000, 120_000).select(F.xxhash64("id").alias("h"))
    assert some.where(keyed.marked(F.col("h"), some)).count() == 20_000 and other.where(keyed.marked(F.col("h"), some)).count() < 10_000
    assert other.where(keyed.marked(F.col("h"), some.where("false"))).count() == 0
