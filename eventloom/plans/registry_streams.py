"""Stream jobs run to the end of the given tables; each result is a table of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import conform
from ..session import ensure_checkpoint_dir
from ..sources import payload, published, snapshots
from ..streaming import admission, curated, intake
from . import adapters as A
from .registry import ev, query


def _scratch(spark) -> str:
    """A fresh folder below the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf, name: str) -> DataFrame:
    schema = A.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _run(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    root = _scratch(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{root}/out" if mode == "complete" else f"{root}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("r1_intake_stream", "SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS event_id, 'Visit of ' || CAST(user_id AS VARCHAR) AS title FROM events")
def _(spark, sf):
    c = F.col
    user, none = c("user_id").cast("string"), F.lit(None).cast("string")
    items = _stream(spark, sf, "events").select(
        F.concat(F.lit("u"), user).alias("event_id"), F.concat(F.lit("Visit of "), user).alias("title"),
        F.concat(F.lit("https://s.example/"), user).alias("url"), c("ts").cast("timestamp").alias("received_at"),
        *[none.alias(n) for n in payload._FIELDS if n not in ("event_id", "title", "url")])
    return _run(intake.intake(items, A.CAPTION_NOW, late="60 days"), "append").select("event_id", "title")


@query("r3_weekly_counts_stream", """SELECT event_type AS city, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, count(*) AS n_events
  FROM events GROUP BY 1, 2""")
def _(spark, sf):
    e = _stream(spark, sf, "events").select(F.col("event_type").alias("city"), F.col("ts").cast("timestamp").alias("start_ts"))
    return _run(intake.weekly_counts(e), "complete").select(
        "city", F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "n_events")


@query("r4_expiry_alerts", """SELECT CAST(user_id AS VARCHAR) AS event_id FROM events GROUP BY user_id
  HAVING max(ts) + INTERVAL 7 HOUR <= (SELECT max(ts) FROM events)""")
def _(spark, sf):
    e = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("event_id"),
                                            F.col("ts").cast("timestamp").alias("start_ts"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    try:
        return _run(intake.expiry_alerts(e), "append").select("event_id")
    finally:
        spark.conf.set(provider, before)


@query("r1_admission_against_the_store", """SELECT 'u' || CAST(user_id AS VARCHAR) AS event_id, 'Visit of ' || CAST(user_id AS VARCHAR) AS title,
  CAST(min(event_id % 4) AS INT) AS batch FROM events GROUP BY user_id""")
def _(spark, sf):
    """Visits arrive in four batches; each admits the users that no batch before it knows. The first batch then comes once more."""
    root, user = _scratch(spark), F.col("user_id").cast("string")
    visits = A.table(spark, sf, "events").select(F.concat(F.lit("u"), user).alias("event_id"), F.concat(F.lit("https://s.example/"), user).alias("url"),
                                                 F.concat(F.lit("Visit of "), user).alias("title"), (F.col("event_id") % 4).alias("arrival"))
    for k in range(4):
        visits.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{root}/in")
        admission.start(spark.readStream.schema(visits.drop("arrival").schema).parquet(f"{root}/in"), f"{root}/table", f"{root}/state").awaitTermination()
    if admission.admit_batch(spark, f"{root}/table", 0, visits.drop("arrival"), ("event_id",)):
        raise RuntimeError("a batch that is done was taken again")
    return admission.read(spark, f"{root}/table").select("event_id", "title", F.col("batch").cast("int").alias("batch"))


@query("r2_continuous_merge", """SELECT 'p' || CAST(min(seq) AS VARCHAR) AS event_id, count(*) AS n_members,
  arg_max(title, length(title) * 1000000 - seq % 1000) AS title, arg_max(priority, score * 1000000 - seq % 1000) AS priority, max(score) AS score,
  CASE WHEN count(*) = 1 THEN 'Eventbrite' WHEN count(*) = 2 THEN 'Eventbrite, AllEvents' ELSE 'Eventbrite, AllEvents, Facebook Events' END AS source
  FROM postings GROUP BY orderkey""")
def _(spark, sf):
    """Postings arrive in three batches: most first ones, then new events beside later postings of known ones, then the rest."""
    root = _scratch(spark)
    postings = A.view(spark, sf, A.POSTINGS)
    n, late = F.col("seq") % 1000, F.col("orderkey") % 4 == 0
    arrival = F.when((n == 0) & ~late, 0).when(late & (n <= 1) | (n == 1), 1).otherwise(2)
    fields = conform(postings.limit(0)).schema
    for k in range(3):
        conform(postings.where(arrival == k)).write.mode("append").parquet(f"{root}/in")
        curated.start(spark.readStream.schema(fields).parquet(f"{root}/in"), f"{root}/table", f"{root}/state").awaitTermination()
    return curated.read(spark, f"{root}/table").select("event_id", "n_members", "title", "priority", "score", "source")


@query("s16_publish", """SELECT event_id, title, 2 AS n_copies FROM ev WHERE seq % 7 <> 0""")
def _(spark, sf):
    root = _scratch(spark)
    rows = ev(spark, sf).select("event_id", F.when(F.col("seq") % 7 == 0, F.lit(" ")).otherwise(F.col("title")).alias("title"))
    if not snapshots.publish(rows, [f"{root}/a", f"{root}/b"]) or snapshots.publish(rows.withColumn("title", F.lit("")), [f"{root}/a"]):
        raise RuntimeError("a table of titles is published, one without is refused")
    both = spark.read.parquet(f"{root}/a").unionByName(spark.read.parquet(f"{root}/b"))
    return both.groupBy("event_id", "title").agg(F.count("*").cast("int").alias("n_copies"))


@query("s16_publish_in_versions", """SELECT event_id, title, 1 AS version FROM ev WHERE seq % 7 <> 0 UNION ALL SELECT event_id, title || ' second', 2 FROM ev""")
def _(spark, sf):
    """A version with blank titles left out, a refused table in between, a second version; both read back from one of two targets."""
    root, rows = _scratch(spark), ev(spark, sf).select("event_id", "seq", "title")
    roots = [f"{root}/a", f"{root}/b"]
    first = rows.select("event_id", F.when(F.col("seq") % 7 == 0, F.lit(" ")).otherwise(F.col("title")).alias("title"))
    refused = rows.select("event_id", F.when(F.col("seq") % 2 == 0, F.col("title")).alias("title"))
    second = rows.select("event_id", F.concat("title", F.lit(" second")).alias("title"))
    if [published.publish(d, roots) for d in (first, refused, second)] != [True, False, True]:
        raise RuntimeError("tables of titles are published, one without is refused")
    return published.read(spark, roots[0], 1).withColumn("version", F.lit(1)).unionByName(published.read(spark, roots[1]).withColumn("version", F.lit(2)))


@query("s17_versions", """SELECT event_id, title || ' second' AS title FROM ev WHERE seq % 3 <> 0""")
def _(spark, sf):
    root, rows = _scratch(spark), ev(spark, sf).select("event_id", "seq", "title")
    snapshots.write_versioned(rows.select("event_id", "title"), root, "20230614T0900")
    snapshots.write_versioned(rows.where("seq % 3 <> 0").select("event_id", F.concat("title", F.lit(" second")).alias("title")), root, "20230615T0900")
    return snapshots.read_latest(spark, root)
