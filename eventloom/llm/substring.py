"""Substring de-duplication with difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named, words_in_blocks

WINDOW = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)  # every difference modulo 21 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1
SKETCH_BITS = 27
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, starts: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """Hashes of the word sequences of a length at the given starts."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(length):
        out = out * factor + hashes[starts + k]
    return out ^ (out >> np.uint64(29))


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts at cover positions, and the hashes of their ANCHOR words."""
    at = np.arange(max(0, len(hashes) - ANCHOR + 1))
    at = at[np.isin(at % PERIOD, COVER)]
    return at, rolled(hashes, at, ANCHOR, _M1)


def candidates(hashes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor the sketch knows, at an offset below PERIOD."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, h = anchors(hashes)
    bit = (h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
    at = at[(seen[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
    edge = np.zeros(n + PERIOD + 1, np.int32)
    np.add.at(edge, np.clip(at - PERIOD + 1, 0, n), 1)
    np.add.at(edge, np.clip(at + 1, 0, n), -1)
    return np.nonzero(np.cumsum(edge[:n]) > 0)[0]


def covered(starts: np.ndarray, n: int, length: int = WINDOW) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:n]) > 0


def _documents(batch: pa.RecordBatch) -> Iterator[tuple]:
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield key, (text.as_buffer().to_pybytes().split() if text.is_valid else [])


def _combined(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, one index and the count of each."""
    return np.unique(hashes, return_index=True, return_counts=True)


def repeated_sketch(spark, keyed: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for every anchor hash that occurs more than once."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words_in_blocks(_documents(batch)):
                h = np.concatenate([np.zeros(0, np.uint64), *[anchors(word_hashes(w))[1] for _, w in block]])
                value, _, n = _combined(h)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["h", "n"])

    hashed = keyed.select("row", "body").mapInArrow(emit, "h long, n byte")
    repeated = hashed.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("h").bitwiseAND((1 << SKETCH_BITS) - 1).alias("bit"))
    parts = repeated.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits"))
    sketch = np.zeros(1 << (SKETCH_BITS - 3), np.uint8)
    for part, bits in parts.toLocalIterator():  # at most 2 ** (SKETCH_BITS - 15) parts of 4 KB, whatever the input
        sketch[part << 12:(part + 1) << 12] = np.frombuffer(bits, np.uint8)
    return sketch


def cut_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words joined by one space, and the columns n_words and n_removed.

    A window is 35 consecutive words; every word of a window whose word sequence also starts anywhere else goes. Two equal windows at
    any two positions share an offset below 21 at which both stand on a cover position, so they share an anchor of 15 words there. A
    first pass hashes anchors at cover positions only and marks those seen twice in a bitmap of fixed size; a second hashes the windows
    that hold a marked anchor and finds, by partial counts of 96-bit hashes, the few that occur once; the last pass takes those from the
    candidates and cuts. A full bitmap only makes more candidates; the result does not depend on it.

    Null and empty texts have no words. A row is named by a hash of its id-free content, so repeated rows have their words in common and
    lose them all. Other columns stay as they are; empty tables give no rows. Memory is bounded by blocks of words and one document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    names = [named(c) for c in docs.columns if c not in (text, "n_words", "n_removed")]
    identity = F.xxhash64(*names, F.col(text)) if names else F.xxhash64(F.col(text))
    keyed = docs.select(identity.alias("row"), body.alias("body"))
    shared = spark.sparkContext.broadcast(repeated_sketch(spark, keyed))
    scratch.release()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            for block in words_in_blocks(_documents(batch)):
                first, second, rows, starts = [], [], [], []
                for key, words in block:
                    h = word_hashes(words)
                    at = candidates(h, seen)
                    if len(at):
                        first.append(rolled(h, at, WINDOW, _M1))
                        second.append((rolled(h, at, WINDOW, _M2) >> np.uint64(32)).astype(np.int32))
                        rows.append(np.full(len(at), key, np.int64))
                        starts.append(at)
                if first:
                    first, second, rows, starts = map(np.concatenate, (first, second, rows, starts))
                    _, index, n = _combined(first)  # equal first hashes of a block with other second hashes are kept apart below
                    alone = n == 1
                    again = np.setdiff1d(np.arange(len(first)), index[alone], assume_unique=True)
                    index, n = np.concatenate([index[alone], again]), np.concatenate([n[alone], np.ones(len(again), np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array(first[index].view(np.int64)), pa.array(second[index]), pa.array(np.minimum(n, 2).astype(np.int8)),
                                                      pa.array(rows[index]), pa.array(starts[index].astype(np.int32))], names=["h", "g", "n", "row", "start"])

    counted = keyed.mapInArrow(windows, "h long, g int, n byte, row long, start int").groupBy("h", "g").agg(
        F.sum("n").alias("n"), F.min("row").alias("row"), F.min("start").alias("start"))
    single = counted.where("n = 1").groupBy("row").agg(F.collect_list("start").alias("__llm_single"))
    single = scratch.keep(single.withColumnRenamed("row", "__llm_row"))
    scratch.release()

    @F.arrow_udf("text string, n_words long, n_removed long")
    def cut(texts: pa.Array, singles: pa.Array) -> pa.Array:
        seen, kept, n_words, n_removed = shared.value, [], [], []
        for t, alone in zip(texts, singles):
            words = t.as_buffer().to_pybytes().split()
            starts = candidates(word_hashes(words), seen) if len(words) >= WINDOW else np.zeros(0, np.int64)
            if alone.is_valid and len(starts):
                starts = np.setdiff1d(starts, alone.values.to_numpy(), assume_unique=True)
            n_words.append(len(words))
            if len(starts):
                gone = covered(starts, len(words))
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                                          names=["text", "n_words", "n_removed"])

    out = (docs.withColumns({"__llm_hash": identity, "__llm_body": body}).join(single.hint("shuffle_hash"), F.col("__llm_hash") == F.col("__llm_row"), "left")
           .withColumn("__llm_cut", cut(F.col("__llm_body"), F.col("__llm_single"))))
    return out.select(*[F.col("__llm_cut.text").alias(text) if c == text else named(c) for c in docs.columns if c not in ("n_words", "n_removed")],
                      F.col("__llm_cut.n_words").alias("n_words"), F.col("__llm_cut.n_removed").alias("n_removed"))


SQL = f"""
WITH w AS (
  SELECT doc_id, i, words[i] AS word, len(words) AS n, CASE WHEN i + {WINDOW - 1} <= len(words) THEN md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) END AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents))),
twice AS (SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
marked AS (SELECT w.*, t.h IS NOT NULL AS dup FROM w LEFT JOIN twice t ON w.h = t.h),
kept AS (SELECT doc_id, i, word, max(CAST(dup AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
sums AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256 FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id"""
