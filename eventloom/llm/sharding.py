"""Sharding by rendezvous hashing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def _unit(text: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of a digest."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest score ``weight / -ln(u(key, shard))``; a heavier shard gets rows in proportion to its weight, and a
    new one takes rows only into itself. A null key counts as the empty text; on a tie the larger number wins."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((F.lit(float(w)) / -F.log(_unit(F.concat(text, F.lit(f":{s}"))))).alias("score"), F.lit(s).alias("shard"))
              for s, w in enumerate(weights) if w > 0]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law ``key``, shard, slot, grown_shard.

    The key and the weights alone decide the shard; ``grown`` are the weights after growth. Slots number the rows of a shard from 0
    without gaps: rows are numbered inside ``BUCKETS`` hash buckets of the shard (ties, repeated rows and null keys in any order) and
    shifted by the sizes of the buckets before, a table of at most shards x BUCKETS rows. Texts never move. A null text has size 1 and
    checksum 0. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    label = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                       rendezvous(F.col(key), weights).alias("shard"), rendezvous(F.col(key), grown).alias("grown_shard"),
                       F.conv(F.substring(F.md5(F.concat(label, F.lit(":bucket")).cast("binary")), 1, 3), 16, 10).cast("int").alias("bucket"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    shifts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # at most len(weights) * BUCKETS rows of three numbers, whatever the input
    return (rows.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(shifts), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot"), "grown_shard"))


def shard_sql(shards: int) -> str:
    """The same in DuckDB SQL for equal weights."""
    def unit(s: int) -> str:
        return f"((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{s}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"

    def best(n: int) -> str:
        return f"list_max([{', '.join(f'{{score: 1.0 / -ln({unit(s)}), shard: {s}}}' for s in range(n))}]).shard"

    # the checksum goes byte by byte through the table of the reflected polynomial 0xEDB88320
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = f"list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: {step}))"
    octets = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"""
WITH polynomial AS (SELECT {table} AS t),
rows AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST({crc} AS BIGINT) AS text_crc32, {best(shards)} AS shard,
    {best(shards + 1)} AS grown_shard, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':bucket'), 1, 3))::INT AS bucket
  FROM documents, polynomial)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INT) AS grown_shard FROM rows"""
