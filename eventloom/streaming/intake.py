"""Stream jobs: announcement intake, continuous merge, weekly counts, expiry alerts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.keyed import with_sequence
from ..plans.jobs import incremental_pass
from ..schema import conform
from ..sources.payload import admit, import_records

EXPIRY_HOURS = 6


def intake(items: DataFrame, ref_now: datetime, received: str = "received_at", late: str = "3 days") -> DataFrame:
    """Import items of a stream as records, repeats of an id within the watermark dropped.

    Rows of one id hash to one state partition; state leaves with the watermark, so it is bounded by
    ``late`` worth of distinct ids.
    """
    records = import_records(items, ref_now, keep=(received,))
    return records.withWatermark(received, late).dropDuplicatesWithinWatermark(["event_id"])


def start_intake(records: DataFrame, table: str, checkpoint: str, received: str = "received_at"):
    """Append records whose id and link the stored table does not know; a batch that runs again
    writes to the same folder, so nothing is stored twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{table}/batch={batch_id}"
        known = _other_batches(spark, table, batch_id, batch)
        admit(batch, known, [received, "event_id", "title"]).write.mode("overwrite").parquet(target)

    return (records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _other_batches(spark, table: str, batch_id: int, like: DataFrame) -> DataFrame:
    """Rows stored by earlier batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    earlier = [f for f in folders if f.startswith("batch=") and int(f[6:]) < batch_id]
    if not earlier:
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(*[f"{table}/{f}" for f in earlier])


def start_merge(records: DataFrame, table: str, checkpoint: str, ref_now: datetime, months: int = 6):
    """Merge each batch of fresh records into the curated table, kept as versions of one folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = with_sequence(conform(batch), ["event_id", "url", "title"])
        stored = _version_before(spark, table, batch_id)
        merged = incremental_pass(fresh, stored if stored is not None else fresh.limit(0), ref_now, months)
        out = with_sequence(merged.drop("seq"), ["event_id", "url", "title"])
        out.write.mode("overwrite").parquet(f"{table}/version={batch_id}")

    return (records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _version_before(spark, table: str, batch_id: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    numbers = [int(n[8:]) for n in names if n.startswith("version=") and int(n[8:]) < batch_id]
    return spark.read.parquet(f"{table}/version={max(numbers)}") if numbers else None


def current_version(spark, table: str) -> DataFrame | None:
    return _version_before(spark, table, 1 << 62)


def weekly_counts(events: DataFrame, city: str = "city", at: str = "start_ts", late: str = "7 days") -> DataFrame:
    """Events per city and Monday week.  Counting is partial per task; state is one counter per group."""
    week = F.window(F.col(at), "7 days", "7 days", "4 days")
    return (events.withWatermark(at, late).groupBy(F.lower(F.col(city)).alias("city"), week.alias("w"))
            .agg(F.count("*").alias("n_events"))
            .select("city", F.col("w.start").alias("week_start"), "n_events"))


def expiry_processor() -> StatefulProcessor:
    # a nested class travels to the executors by value, so they need not have this package
    class ExpiryAlerts(StatefulProcessor):
        """Emit an event once its start lies six hours back in event time: one timer and one value per id."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.start = handle.getValueState("start", "start_ms long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            latest = None
            for pdf in rows:
                top = pdf["start_ts"].max()
                latest = top if latest is None or top > latest else latest
            if latest is not None:
                due = int(latest.timestamp() * 1000) + 6 * 3_600_000
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.start.update((int(latest.timestamp() * 1000),))
                self.handle.registerTimer(due)
            yield pd.DataFrame({"event_id": pd.Series([], dtype="str"), "start_ms": pd.Series([], dtype="int64")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            start = self.start.get()[0]
            self.start.clear()
            yield pd.DataFrame({"event_id": [str(key[0])], "start_ms": [start]})

        def close(self) -> None:
            pass

    return ExpiryAlerts()


def expiry_alerts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(event_id, start_ms) of events that left the active set; ``start_ts`` is event time.

    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    return (events.withWatermark("start_ts", late).groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=expiry_processor(), outputStructType="event_id string, start_ms long", outputMode="Append",
        timeMode="EventTime"))
