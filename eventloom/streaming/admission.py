"""Admission of new records against everything stored, batch by batch.

Below one folder, every part Parquet:

* ``rows/batch=k``: the records that batch k admitted
* ``keys/batch=k/cell=c``: their ids and links (kind, value), dealt to cells by hash
* ``filters/batch=k``: a Bloom filter for each cell of the batch (cell, words)
* ``ledger/batch=k``: the number of records admitted, written last; a batch in the ledger is done and is not taken again

A new batch asks the filters first. Only the key folders (batch, cell) that may hold one of its keys are opened, and only their rows are
compared exactly, so most of what was stored years ago is never read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import text
from ..session import cut_lineage, whole_folders
from ..sources.payload import admit

CELLS = 64
PROBES, BITS_PER_KEY = 4, 12  # about one false alarm in two hundred


def _keys(rows: DataFrame) -> DataFrame:
    """(kind, value, cell) of ids and links; ``#`` and blanks are neither."""
    link = F.when(~text(F.col("url")).isin("", "#"), F.col("url"))
    ids = rows.select(F.lit("id").alias("kind"), F.nullif(F.col("event_id"), F.lit("")).alias("value"))
    both = ids.unionByName(rows.select(F.lit("link").alias("kind"), link.alias("value"))).where("value IS NOT NULL")
    return both.distinct().withColumn("cell", F.pmod(F.xxhash64("kind", "value"), F.lit(CELLS)).cast("int"))


def _place(probe: int, words: Column) -> Column:
    """The bit of a key that a probe asks, in a filter of so many words of 64 bits."""
    return F.pmod(F.xxhash64(F.lit(probe), "kind", "value"), words * 64)


def _filters(keys: DataFrame) -> DataFrame:
    """(cell, words): a filter per cell, sized by its own number of keys; bits are or-ed on the map side."""
    sized = keys.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * BITS_PER_KEY / 64)).cast("int").alias("n"))
    bits = keys.join(sized, "cell").select("cell", "n", F.explode(F.array(*(_place(p, F.col("n")) for p in range(PROBES)))).alias("bit"))
    word = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    filled = bits.groupBy("cell", "n", F.floor(F.col("bit") / 64).cast("int").alias("at")).agg(F.bit_or(word).alias("word"))
    listed = filled.groupBy("cell", "n").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))  # one cell of one batch
    return listed.select("cell", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("words"))


def _known(spark: SparkSession, root: str, before: list[int], keys: DataFrame) -> DataFrame:
    """(event_id, url) of stored records that share an id or a link with the batch."""
    if not before:
        return spark.createDataFrame([], "event_id string, url string")
    filters = spark.read.option("basePath", f"{root}/filters").parquet(*[f"{root}/filters/batch={k}" for k in before])
    n = F.size("words")

    def held(probe: int) -> Column:
        bit = _place(probe, n)
        word = F.element_at("words", (F.floor(bit / 64) + 1).cast("int"))
        return F.getbit(word, (bit % 64).cast("int")) == 1

    probable = keys.join(filters, "cell").where(reduce(lambda a, b: a & b, (held(p) for p in range(PROBES))))
    folders = sorted((r["batch"], r["cell"]) for r in probable.select("batch", "cell").distinct().collect())  # names of folders
    if not folders:
        return spark.createDataFrame([], "event_id string, url string")
    stored = spark.read.option("basePath", f"{root}/keys").parquet(*[f"{root}/keys/batch={b}/cell={c}" for b, c in folders])
    same = cut_lineage(stored.select("kind", "value").join(keys.select("kind", "value"), ["kind", "value"], "left_semi"))
    return same.select(F.when(F.col("kind") == "id", F.col("value")).alias("event_id"), F.when(F.col("kind") == "link", F.col("value")).alias("url"))


def admit_batch(spark: SparkSession, root: str, batch: int, records: DataFrame, order: tuple[str, ...]) -> int:
    """Store the records of a batch that no earlier batch knows by id or link; the first by ``order`` wins within the batch.

    Returns how many were admitted, 0 for a batch that the ledger has already. A broken batch has no entry and is written anew.
    """
    done = [int(n.removeprefix("batch=")) for n in whole_folders(spark, f"{root}/ledger")]
    if batch in done:
        return 0
    records = cut_lineage(records)
    keys = cut_lineage(_keys(records))
    known = _known(spark, root, done, keys)
    admit(records, known, list(order)).write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
    stored = spark.read.schema(records.schema).parquet(f"{root}/rows/batch={batch}")
    own = cut_lineage(_keys(stored))
    own.repartition(CELLS, "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/keys/batch={batch}")
    _filters(own).write.mode("overwrite").parquet(f"{root}/filters/batch={batch}")
    admitted = stored.count()
    spark.createDataFrame([(admitted,)], "n_admitted long").write.mode("overwrite").parquet(f"{root}/ledger/batch={batch}")
    return admitted


def read(spark: SparkSession, root: str) -> DataFrame:
    """The admitted records, with the batch that brought them; what a broken batch left is not among them."""
    done = whole_folders(spark, f"{root}/ledger")
    return spark.read.option("basePath", f"{root}/rows").parquet(*[f"{root}/rows/{n}" for n in done])


def start(records: DataFrame, root: str, checkpoint: str, order: tuple[str, ...] = ("event_id", "url", "title")):
    """Admit a stream of records (``event_id``, ``url`` and what else they have) into the table below ``root``."""
    spark = records.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/arrived/batch={batch_id}"  # written first: the rest runs in the outer session with its adaptive plans
        batch.write.mode("overwrite").parquet(path)
        admit_batch(spark, root, batch_id, spark.read.schema(batch.schema).parquet(path), order)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
