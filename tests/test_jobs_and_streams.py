"""Jobs, stored tables and stream jobs; stream results equal their batch counterparts."""

from datetime import datetime, timedelta
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from eventloom.operators.clash import flag_clashes
from eventloom.operators.keyed import with_sequence
from eventloom.plans import jobs
from eventloom.schema import event_frame
from eventloom.sources import snapshots
from eventloom.streaming import intake

NOW = datetime(2026, 9, 19, 15, 0)


def some_events(spark, n=60):
    return event_frame(spark, [dict(
        event_id=f"e{i}", title=f"Talk {md5(str(i).encode()).hexdigest()[:24]}", source="Eventbrite", city="Cairo" if i % 3 else "Tanta",
        url=f"https://x.org/{i}", start_date=NOW + timedelta(days=i % 20 + 1), description="plain") for i in range(n)])


def test_clash_details(spark):
    at = NOW + timedelta(days=10)
    df = event_frame(spark, [dict(event_id=e, title=t, city=c, start_date=at) for e, t, c in (
        ("a", "A1", "Cairo"), ("a", "A2", "cairo"), ("a", "A3", "Cairo"), ("a", "A4", "Cairo"), ("b", "B", "Cairo"), ("c", "C", "Giza"))])
    got = {r["title"]: (r["clash_warning"], r["clash_count"], r["clash_details"]) for r in flag_clashes(df).collect()}
    assert got["A1"] == (True, 5, ["B"]) and got["B"] == (True, 5, ["A1", "A2", "A3"]) and got["C"] == (False, 0, [])


def test_sequence_is_dense_and_ordered(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"))
    got = [(r["k"], r["seq"]) for r in with_sequence(df, ["k"]).collect()]
    assert sorted(s for _, s in got) == list(range(1, 501)) and sorted(got) == sorted(got, key=lambda r: r[1])


def test_full_and_incremental_pass(spark):
    df = some_events(spark)
    copies = df.where("seq <= 10").withColumns({"event_id": F.concat(F.lit("z"), "event_id"), "url": F.concat("url", F.lit("/copy")),
                                                "source": F.lit("AllEvents")})
    first = jobs.full_pass([df.drop("seq"), copies.drop("seq")], NOW).collect()
    assert len(first) == 60
    assert sum(r["source"] == "Eventbrite, AllEvents" for r in first) == 10
    dates = [r["start_date"] for r in first]
    assert dates == sorted(dates)
    again = jobs.incremental_pass(df.where("seq <= 30"), df, NOW).collect()
    assert {r["event_id"] for r in again} == {r["event_id"] for r in first}


def test_snapshots(spark, tmp_path):
    df = some_events(spark)
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert snapshots.publish(df, paths, fmt="json") and not snapshots.publish(df.withColumn("title", F.lit("")), paths)
    assert snapshots.read_snapshot(spark, paths[0], NOW).count() == 60
    assert snapshots.read_snapshot(spark, paths[0], NOW, min_rows=61) is None
    same = snapshots.parity({p: spark.read.json(p) for p in paths}).collect()
    assert all(r["all_equal"] for r in same)
    sheet = str(tmp_path / "sheet")
    snapshots.write_csv(snapshots.to_sheet(df), sheet)
    assert snapshots.read_sheet(spark, sheet).count() == 60
    hist = str(tmp_path / "hist")
    snapshots.write_versioned(df, hist, "20260101_000000")
    snapshots.write_versioned(df.where("seq <= 5"), hist, "20260102_000000")
    assert snapshots.read_latest(spark, hist).count() == 5


def test_weekly_counts_stream_equals_batch(spark, tmp_path):
    rows = some_events(spark).select("city", F.col("start_date").cast("timestamp").alias("start_ts"))
    src = str(tmp_path / "src")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = (intake.weekly_counts(stream).writeStream.format("memory").queryName("weekly").outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("weekly").collect())) == sorted(map(tuple, intake.weekly_counts(rows).collect()))


def items(spark, ids):
    names = ("title", "date_display", "location", "city", "description", "caption", "source", "ticket_type", "organizer",
             "organizer_email", "organizer_phone", "organizer_instagram", "category", "registration_url")
    df = spark.createDataFrame([(f"i{i}", f"https://s.org/{i}", NOW + timedelta(minutes=i)) for i in ids],
                               "event_id string, url string, received_at timestamp")
    for n in names:
        df = df.withColumn(n, F.lit(None).cast("string"))
    return df.withColumns({"title": F.concat(F.lit("Robotics Evening "), F.substring(F.md5("event_id"), 1, 12)),
                           "date_display": F.lit("Oct 3, 2026")})


def test_intake_and_merge(spark, tmp_path):
    src, table, merged = (str(tmp_path / n) for n in ("src", "table", "merged"))
    items(spark, [1, 2, 3, 3]).coalesce(1).write.parquet(src)
    schema = items(spark, [1]).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        intake.start_intake(intake.intake(stream, NOW), table, str(tmp_path / "ck1")).awaitTermination()
        intake.start_merge(intake.intake(stream, NOW), merged, str(tmp_path / "ck2"), NOW).awaitTermination()

    run()
    assert spark.read.parquet(table).count() == 3
    items(spark, [3, 4]).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r["event_id"] for r in spark.read.parquet(table).collect()) == ["i1", "i2", "i3", "i4"]
    assert sorted(r["event_id"] for r in intake.current_version(spark, merged).collect()) == ["i1", "i2", "i3", "i4"]


def test_expiry_alerts(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "src")
    rows = spark.createDataFrame([("a", NOW), ("b", NOW + timedelta(hours=1)), ("c", NOW + timedelta(days=2))],
                                 "event_id string, start_ts timestamp")
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = (intake.expiry_alerts(stream).writeStream.format("memory").queryName("expired").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("expired").collect()) == ["a", "b"]
