"""Key-based building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16
HOT_ROWS = 20_000  # rows of one key that one task takes
MOST_MARKS = 1 << 28  # bits of a bitmap, 32 MB: with more hashes than fit it lets more of the others pass, and still all that are asked for
BLOCK = 1024  # words of 64 bits


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS,
                  salt_on: Column | None = None, n: str | None = None) -> DataFrame:
    """Join ``rows`` to a ``table`` with at most one row per key.

    A plain equi-join sends all rows of a hot key to one task.  Here the rows carry a salt derived
    from their own values and the (small, one row per key) table is repeated once per salt, so
    a hot key is spread over ``salts`` tasks.  ``n`` names a column of the table that says how many rows its key has at
    most: only keys of over HOT_ROWS are then repeated, so the table travels once, and the column is dropped.  The salts come
    from a cross join, which the planner counts into the size of the table: a table of small files
    is broadcast only when adaptive execution has measured that it is small with its salts.
    """
    own = [c for c in rows.columns if c not in keys]
    salt = F.pmod(F.xxhash64(salt_on if salt_on is not None else F.struct(*(own or keys))), F.lit(salts)).cast("int")
    salted = rows.withColumn("_salt", salt)
    each = F.broadcast(rows.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt")))
    if n is None:
        return salted.join(table.crossJoin(each), [*keys, "_salt"], how).drop("_salt")
    hot = table.where(F.col(n) > HOT_ROWS).select(*keys, F.lit(True).alias("_hot"))  # few: each stands for many rows
    spread = reduce(lambda x, y: x | y, [F.col("_hot").isNotNull(), *(F.col(k).isNull() for k in keys)])
    left = salted.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(spread, F.col("_salt")).otherwise(0)).drop("_hot")
    right = table.crossJoin(each).where((F.col("_salt") == 0) | (F.col(n) > HOT_ROWS)).drop(n)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def counted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], among: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` to a ``table`` with at most one row per key that may be large.

    The rows of each key are counted first, so only table rows that are met travel, and only those of hot keys more than once.
    ``among`` is a frame with all these rows, or more, that is cheaper to count.
    """
    own = rows if among is None else among
    met = own.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.count("*").alias("_rows"))
    return salted_lookup(rows, met.join(table.hint("merge"), keys, "left"), keys, n="_rows")


def marked(value: Column, hashes: DataFrame) -> Column:
    """Is a 64-bit hash among ``hashes`` (column ``h``), or shares a bit of a bitmap with one of them? For rows that would travel to a
    join otherwise. The bitmap has 16 bits or more for each of them, up to MOST_MARKS."""
    size = min(max(64 * BLOCK, 1 << (16 * hashes.count()).bit_length()), MOST_MARKS)

    def place(h: Column) -> Column:
        return h.bitwiseAND(F.lit(size - 1))

    def bit(h: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    # all words are there, set or not; blocks keep their lists short
    zero = hashes.sparkSession.range(size // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = hashes.select(F.shiftright(place(F.col("h")), 6).alias("w"), bit(F.col("h")).alias("bits")).unionByName(zero).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    blocks = words.groupBy(F.floor(F.col("w") / BLOCK).alias("b")).agg(F.array_sort(F.collect_list(F.struct("w", "bits")))["bits"].alias("words"))
    marks = blocks.agg(F.array_sort(F.collect_list(F.struct("b", "words")))["words"]).scalar()
    word = F.get(F.get(marks, F.shiftright(place(value), 16).cast("int")), F.shiftright(place(value), 6).bitwiseAND(F.lit(BLOCK - 1)).cast("int"))
    return word.bitwiseAND(bit(value)) != 0


def top_per_key(df: DataFrame, keys: list, order: list, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key.  The rank filter is applied before the shuffle too (window group
    limit), so at most ``k`` rows per key and input partition travel."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, key: str | Column, order: list) -> DataFrame:
    """One row per key, the first in order; rows without a key are all kept."""
    k = F.col(key) if isinstance(key, str) else key
    tagged = df.withColumn("_key", k)
    blank = F.col("_key").isNull() | (F.col("_key").cast("string") == "")
    return (top_per_key(tagged.where(~blank), ["_key"], order, 1)
            .unionByName(tagged.where(blank)).drop("_key"))


def with_sequence(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Dense arrival order 1..n over a total order, without a single-task window.

    Rows are range partitioned, numbered inside each partition and shifted by the sizes of the
    partitions before it (one small row per partition).  The number depends on the data only.
    """
    from ..session import cut_lineage
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = sizes.select("_pid", (F.sum("_n").over(W.orderBy("_pid")) - F.col("_n")).alias("_before"))
    local = ranged.withColumn("_rn", F.row_number().over(W.partitionBy("_pid").orderBy(*order)))
    return (local.join(F.broadcast(before), "_pid")  # one row per partition
            .withColumn(name, (F.col("_before") + F.col("_rn")).cast("long")).drop("_pid", "_rn", "_before"))


def with_place(page: DataFrame, name: str = "place") -> DataFrame:
    """The places 1..n of a served page, a sorted frame that ``limit`` has cut to what one task holds."""
    return page.coalesce(1).withColumn(name, (F.monotonically_increasing_id() + 1).cast("int"))


def anti_by_any(rows: DataFrame, known: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Rows that match ``known`` on none of several keys: one anti join per key, never one OR join.

    ``pairs`` maps a column of ``rows`` to a column of ``known``; blank keys never match.  The known side
    is reduced to distinct keys first, and rows of hot keys are spread by salt, so such a key stays harmless.
    """
    out = rows
    for left, right in pairs.items():
        keys = known.select(F.col(right).alias("_k")).where(F.col("_k").isNotNull() & (F.col("_k") != "")).distinct()
        keyed = out.withColumn("_k", F.col(left))
        out = counted_lookup(keyed, keys.withColumn("_known", F.lit(True)), ["_k"], rows.withColumn("_k", F.col(left))).where("_known IS NULL").select(*rows.columns)
    return out
