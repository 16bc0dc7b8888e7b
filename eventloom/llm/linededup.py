"""Line de-duplication: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACES, UPPER, Scratch, named

MIN_CHARS, MIN_DOCS = 20, 3


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` rewritten and the columns n_lines and n_dropped (replaced where they exist).

    Lines end at ``\\n``; a line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least ``min_chars``
    code points held by at least ``min_docs`` distinct ids loses its lines everywhere but in the largest id holding it. Null and empty
    texts are one empty line and give the empty text. Rows that share an id count as one document; rows with a null id count for
    nothing and lose nothing. Repeated lines of one document count once and go or stay together. Empty tables give no rows.

    Every text is split and hashed once: each document gives one row (hash, id, hash of the text, positions) per distinct long line, which
    is written. Distinct (hash, id) pairs are counted by partial aggregates, so a line in a third of all documents costs one each, and
    the join back to the written rows is split by adaptive execution. Positions to drop travel to the texts, whose other lines are never
    looked at again. The list beside a row has at most as many positions as its own text has lines, however many rows share its id.
    A very long text is split whole, in one task.
    """
    row = F.xxhash64(text)  # rows of one id whose texts share it would share their drops, which are the id's
    sent = (docs.where(named(key).isNotNull() & named(text).isNotNull())
            .select(named(key).alias("id"), row.alias("row"), named(text).cast("binary").alias("body")))
    schema = T.StructType([*sent.schema.fields[:2], T.StructField("hash", T.BinaryType()), T.StructField("places", T.ArrayType(T.IntegerType()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, md5 = SPACES.encode(), hashlib.md5
        for batch in batches:
            owner, hashes, lengths, places, size = [], [], [0], [], 0
            for k, t in enumerate(batch.column(2)):
                body, found = t.as_buffer().to_pybytes(), {}
                for place, line in enumerate(body.split(b"\n")):
                    if len(line) >= min_chars and len(bare := line.strip(spaces)) >= min_chars and (
                            len(bare) >= 4 * min_chars or len(bare.decode()) >= min_chars):
                        found.setdefault(md5(bare.lower()).digest(), []).append(place)
                for h, at in found.items():
                    hashes.append(h)
                    places += at
                    lengths.append(len(places))
                owner += [k] * len(found)
                size += len(found)
                if size >= 100_000 or k == batch.num_rows - 1:
                    keys = [c.take(pa.array(owner, pa.int32())) for c in batch.columns[:2]]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(hashes, pa.binary()), pa.ListArray.from_arrays(
                        pa.array(lengths, pa.int32()), pa.array(places, pa.int32()))], names=["id", "row", "hash", "places"])
                    owner, hashes, lengths, places, size = [], [], [0], [], 0

    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(sent.mapInArrow(hashed, schema))
    pairs = lines.select("hash", "id").distinct()
    frequent = pairs.groupBy("hash").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("hash", "keeper")
    frequent = scratch.keep(frequent)  # a table of its own, so that both sides of the join are plain exchanges, which can be split
    # equal rows drop alike, once; by a column of its own, so that the join of a frequent line can be split
    drops = (lines.join(frequent, "hash").where("id <> keeper").groupBy("id", "row", F.hex("hash")).agg(F.first("places").alias("places"))
             .groupBy("id", "row").agg(F.flatten(F.collect_list("places")).alias("__llm_drops"))
             .select(F.col("id").alias("__llm_id"), F.col("row").alias("__llm_row"), "__llm_drops"))

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def reassemble(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, dropped in columns:
            kept, n_lines, n_dropped = [], [], []
            for body, places in zip(texts, dropped):
                body = body or ""
                if places is not None and len(places):
                    rows, gone = body.split("\n"), set(places.tolist())
                    n_lines.append(len(rows))
                    n_dropped.append(len(gone))
                    body = "\n".join([r for k, r in enumerate(rows) if k not in gone])
                else:
                    n_lines.append(body.count("\n") + 1)
                    n_dropped.append(0)
                kept.append(body)
            yield pd.DataFrame({"text": kept, "n_lines": n_lines, "n_dropped": n_dropped})

    rest = docs.columns
    joined = docs.join(drops, (named(key) == F.col("__llm_id")) & (row == F.col("__llm_row")), "left")
    out = joined.withColumn("__llm_lines", reassemble(named(text), F.col("__llm_drops")))
    fixed = {text: F.col("__llm_lines.text")}
    return out.select(*[fixed.get(c, named(c)).alias(c) for c in rest if c not in ("n_lines", "n_dropped")],
                      F.col("__llm_lines.n_lines").alias("n_lines"), F.col("__llm_lines.n_dropped").alias("n_dropped"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
        FROM documents)),
frequent AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT l.doc_id, l.n, l.line, (f.k IS NOT NULL AND l.doc_id <> f.keeper) AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""
