"""Session helpers: local sessions, and written tables that cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "eventloom") -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the one given."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder of the cluster; set a local one only when none is named and
    the session itself is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


class Scratch:
    """Written tables that cut lineage, in the folder that the session names in ``spark.checkpoint.dir``.

    ``keep`` writes a frame and reads it again; ``drop`` deletes tables no longer needed and ``release`` lets the driver free the
    shuffle files of frames that are gone. The last table of a job stays, for its result is read lazily.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.kept)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(next(p for d, p in self.kept if d is df))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Ask the driver for a garbage collection, after which Spark deletes shuffle files of finished steps."""
        gc.collect()  # the driver's handles on finished plans first
        self.spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder as Parquet and read it back, with its columns' layout and statistics."""
    return Scratch(df.sparkSession).keep(df)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows over all cores before costly work on each of them, whatever their keys.

    A scan is split by row groups at most, and a small or densely packed table of millions of rows may be one: all that Spark does
    before the next shuffle would then run in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def whole_folders(spark: SparkSession, path: str, any_state: bool = False) -> list[str]:
    """Names of the folders below a path that a Spark writer has finished, or of all."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(make(path)):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(make(path)) if s.isDirectory() and (any_state or fs.exists(make(s.getPath(), "_SUCCESS"))))


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
