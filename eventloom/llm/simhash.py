"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, spanning_edges

RADIUS, SHINGLE, SEED, TILE = 3, 3, 42, 8192
LOW, HIGH = 5, 11  # population counts of a 16-bit quarter are clamped to this range, which never widens a difference


def fingerprint_of(text: bytes, words: int = SHINGLE, seed: int = SEED, block: int = 65_536) -> int:
    """The 64-bit fingerprint: a bit is 1 if set in over half of the shingle hashes; no words give 0."""
    tokens = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    hashes = map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, zip(*[tokens[k:] for k in range(words)])))
    ones, n = np.zeros(64, np.int64), len(tokens) - words + 1
    for start in range(0, n, block):
        size = min(block, n - start)
        h = np.fromiter(islice(hashes, size), np.uint64, size)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long; null texts count as empty."""
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        got = np.fromiter((fingerprint_of(bytes(t)) if t is not None else 0 for t in texts), np.uint64, len(texts))
        return pd.Series(got.view(np.int64))

    return docs.withColumn(name, fingerprints(F.col(text).cast("binary")))


def links(scratch: Scratch, reps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``radius`` bits; ``reps`` has one row (fp, node) per fingerprint.

    Fingerprints are tiled by the population counts of their four 16-bit quarters. Two fingerprints differ in at least the sum of the
    differences of those counts, so only tiles whose counts differ by at most the radius meet; there numpy compares every pair by
    exclusive-or and bit count. Tiles hold about ``tile`` fingerprints: a fuller cell is dealt over several by hash. Each tile pair
    returns links that span the same components, at most one per fingerprint, never all pairs of a group.
    """
    quarter = [F.least(F.greatest(F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))), F.lit(LOW)), F.lit(HIGH)) - LOW
               for q in range(4)]
    side = HIGH - LOW + 1
    cell = sum((quarter[q] * side ** q for q in range(1, 4)), quarter[0]).cast("int")
    celled = reps.select("fp", "node", cell.alias("cell"))
    # at most side ** 4 = 2,401 rows of two numbers, whatever the input
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / float(tile)).cast("int").alias("chunks"))
    tiles = scratch.keep(celled.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
                         .groupBy("cell", "chunk").agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes")))
    grid = [tuple(c // side ** q % side for q in range(4)) for c in range(side ** 4)]
    counts = np.array(grid)
    near = [(a, [int(b) for b in np.nonzero(np.abs(counts - counts[a]).sum(axis=1) <= radius)[0] if b >= a]) for a in range(side ** 4)]
    near = scratch.spark.createDataFrame(pd.DataFrame(near, columns=["cell", "others"]), "cell int, others array<int>")
    partners = near.select("cell", F.explode("others").alias("other"))
    # the cells a tile must visit: its own and lower ones within the radius; owners of a full cell come in several chunks
    visits = (tiles.select(F.col("cell").alias("other"), F.col("chunk").alias("other_chunk"), F.col("fps").alias("other_fps"), F.col("nodes").alias("other_nodes"))
              .join(F.broadcast(partners), "other").join(F.broadcast(sizes), "cell")
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("cell <> other OR chunk <= other_chunk"))
    pairs = tiles.join(visits, ["cell", "chunk"]).select("fps", "nodes", "other_fps", "other_nodes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            columns = [batch.column(k) for k in range(4)]
            ends = [c.offsets.to_numpy() for c in columns]
            flat = [c.values.to_numpy() for c in columns]
            for r in range(batch.num_rows):
                a, na, b, nb = (flat[k][ends[k][r]:ends[k][r + 1]] for k in range(4))
                a, b = a.view(np.uint64), b.view(np.uint64)  # numpy counts the bits of absolute values
                found_a, found_b = [], []
                for at in range(0, len(a), 256):
                    hit = np.nonzero(np.bitwise_count(a[at:at + 256, None] ^ b[None, :]) <= radius)
                    differs = na[hit[0] + at] != nb[hit[1]]
                    found_a.append(hit[0][differs] + at)
                    found_b.append(hit[1][differs])
                x, y = np.concatenate(found_a), np.concatenate(found_b)
                if len(x):
                    names, local = np.unique(np.concatenate([na[x], nb[y]]), return_inverse=True)
                    child, root = spanning_edges(local[:len(x)], local[len(x):], len(names))
                    us.append(names[child])
                    vs.append(names[root])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us) if us else np.zeros(0, np.int64)),
                                              pa.array(np.concatenate(vs) if vs else np.zeros(0, np.int64))], names=["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: key, fp (signed long), component_id, the smallest id reachable over fingerprints at ``radius`` or fewer bits.

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints collapse to one node before any comparison,
    so copies cost nothing. Rows that share an id keep their own fingerprints and their components meet in that id. A null id is no
    node: its row gets the component of its fingerprint, or null if no row with an id has that fingerprint.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.keep(with_fingerprint(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_text").select("_id", "fp"))
    reps = marked.where("_id IS NOT NULL").groupBy("fp").agg(F.min("_id").alias("node"))
    # an id with several fingerprints ties their nodes together
    own = marked.where("_id IS NOT NULL").select("_id", "fp").distinct()
    twice = own.groupBy("_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("_id")
    ties = own.join(twice, "_id", "left_semi").select(F.col("_id").alias("u"), "fp").join(reps, "fp").select("u", F.col("node").alias("v"))
    found = components(scratch, links(scratch, reps, radius).union(ties))
    named = reps.join(found, "node", "left")
    named = named.select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, F.col("fp") == F.col("_fp"), "left").select(F.col("_id").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each component the row whose id is the component's stays (one of them, if the id repeats);
    rows with a null id are kept, for nothing names them."""
    firsts = near_duplicates(docs, key, text).where(f"`{key}` = component_id").select(F.col(key).alias("__llm_keep")).distinct()
    known = docs.where(F.col(key).isNotNull()).join(firsts, F.col(key) == F.col("__llm_keep"), "left_semi")
    return known.dropDuplicates([key]).union(docs.where(F.col(key).isNull()))
