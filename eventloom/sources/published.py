"""Publishing a table to several targets in whole versions.

A write makes data files first, for all targets in one pass over the rows; its commit counts what the tasks report, refuses a table with
too many blank titles, and only then adds one manifest per target. Readers see the files of the last manifest, or of an earlier one, and
never a half-written version. One job at a time publishes to a target.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .snapshots import _blank

MIN_VALID = 0.7
REFUSED = "publish refused"
_VALID = "__valid"


def _store(uri: str):
    """File system and path of a URI (a plain path is local)."""
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(uri)


def _manifests(root: str) -> list[int]:
    from pyarrow.fs import FileSelector
    fs, path = _store(f"{root}/manifest")
    names = [f.base_name for f in fs.get_file_info(FileSelector(path, allow_not_found=True))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _manifest(root: str, version: int) -> dict:
    fs, path = _store(f"{root}/manifest/{version:08d}.json")
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: the same file names below every target, rows seen, rows kept."""
    files: list = field(default_factory=list)
    rows: int = 0
    kept: int = 0


class Publisher(DataSourceArrowWriter):
    """Parquet files below ``data`` of every target; a manifest when all tasks are done and enough rows are valid."""

    def __init__(self, roots: list[str], min_valid: float):
        self.roots, self.min_valid = roots, min_valid

    def write(self, iterator) -> Written:
        import pyarrow.parquet as pq
        done, sinks = Written(), []
        for batch in iterator:
            done.rows += batch.num_rows
            kept = batch.filter(batch.column(_VALID)).drop_columns([_VALID])
            done.kept += kept.num_rows
            if not sinks and kept.num_rows:
                done.files.append(f"{uuid.uuid4().hex}.parquet")
                for root in self.roots:
                    fs, path = _store(f"{root}/data/{done.files[0]}")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    sinks.append(pq.ParquetWriter(path, kept.schema, filesystem=fs))
            for sink in sinks:
                sink.write_batch(kept)
        for sink in sinks:
            sink.close()
        return done

    def commit(self, messages: list) -> None:
        told = [m for m in messages if m is not None]
        rows, kept = sum(m.rows for m in told), sum(m.kept for m in told)
        if not rows or kept < rows * self.min_valid:
            raise ValueError(f"{REFUSED}: {kept} of {rows} rows are valid")
        files = [f for m in told for f in m.files]
        for root in self.roots:
            version = max(_manifests(root), default=0) + 1
            fs, path = _store(f"{root}/manifest/{version:08d}.json")
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as f:
                f.write(json.dumps({"files": files, "rows": kept}).encode())
            fs.move(part, path)

    def abort(self, messages: list) -> None:
        for m in messages:
            for name in m.files if m is not None else ():
                for root in self.roots:
                    fs, path = _store(f"{root}/data/{name}")
                    fs.delete_file(path)


class Published(DataSource):
    """``df.write.format("published").option("roots", json list).option("min_valid", x).mode("append").save()``"""

    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema, overwrite: bool) -> Publisher:
        return Publisher(json.loads(self.options["roots"]), float(self.options.get("min_valid", MIN_VALID)))


def publish(df: DataFrame, roots: list[str], title: str = "title", min_valid: float = MIN_VALID) -> bool:
    """Publish the rows with a title as the next version of every target (a URI that pyarrow can write on all workers).

    False, and nothing changed, for an empty table or one with too few titles. The frame is evaluated once.
    """
    df.sparkSession.dataSource.register(Published)
    marked = df.withColumn(_VALID, ~_blank(F.col(title)))
    try:
        marked.write.format("published").option("roots", json.dumps(roots)).option("min_valid", str(min_valid)).mode("append").save()
    except Exception as e:  # the commit's own refusal comes back wrapped
        if REFUSED not in str(e):
            raise
        return False
    return True


def versions(root: str) -> list[int]:
    return _manifests(root)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last one by default; scans are Spark's own."""
    known = _manifests(root)
    if not known:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(*[f"{root}/data/{name}" for name in _manifest(root, known[-1] if version is None else version)["files"]])


def forget(root: str, keep: int = 1) -> int:
    """Remove all but the last ``keep`` versions and the files that only they name; returns the number of data files removed."""
    from pyarrow.fs import FileSelector
    known = _manifests(root)
    held = {name for v in known[-keep:] for name in _manifest(root, v)["files"]}
    gone = {name for v in known[:-keep] for name in _manifest(root, v)["files"]} - held
    for v in known[:-keep]:
        fs, path = _store(f"{root}/manifest/{v:08d}.json")
        fs.delete_file(path)
    fs, path = _store(f"{root}/data")
    there = {f.base_name for f in fs.get_file_info(FileSelector(path, allow_not_found=True))}
    for name in gone & there:
        fs.delete_file(f"{path}/{name}")
    return len(gone & there)
