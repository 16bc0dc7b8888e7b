"""Fill-in-middle transformation: cut points come from a set of unit ends in array, bitmap and run containers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
CELL = 1 << 16  # values of one container
MOST_LISTED = 4096  # values up to which a container is a list; above, its bitmap is smaller
MOST_TEXT_BYTES = 4 << 20  # of texts whose results a task holds at once, beside one document


class Boundaries:
    """A sorted set of positions. Values are dealt to containers by their high bits; each is held as a list of its low 16 bits, as a
    bitmap with counts per word, or as runs with counts per run, whichever is smallest. Cumulative cardinalities of the containers
    find the container of the k-th value; a select inside it finds the value."""

    def __init__(self, values: np.ndarray):
        cells = values // CELL
        starts = np.nonzero(np.diff(cells, prepend=-1))[0]
        self.keys = cells[starts]
        self.before = np.append(starts, len(values))  # values before each container, and all at the end
        self.containers = [self._container((values[a:b] % CELL).astype(np.uint16)) for a, b in zip(self.before, self.before[1:])]

    @staticmethod
    def _container(low: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
        breaks = np.nonzero(np.diff(low.astype(np.int32)) != 1)[0] + 1
        begin = np.concatenate([[0], breaks])
        if 4 * len(begin) < min(2 * len(low), CELL // 8):  # a run takes four bytes, a listed value two
            return "run", low[begin], begin
        if len(low) <= MOST_LISTED:
            return "array", low, low[:0]
        bits = np.zeros(CELL, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        return "bitmap", words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest value, from 0."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        kind, data, counts = self.containers[at]
        k -= int(self.before[at])
        if kind == "array":
            low = int(data[k])
        elif kind == "run":
            run = int(np.searchsorted(counts, k, side="right")) - 1
            low = int(data[run]) + k - int(counts[run])
        else:
            word = int(np.searchsorted(counts, k, side="right")) - 1
            left, value, low = k - int(counts[word]), int(data[word]), word * 64
            for _ in range(left):
                value &= value - 1
            low += (value & -value).bit_length() - 1
        return int(self.keys[at]) * CELL + low


def line_ends(text: str) -> np.ndarray:
    """Code point offsets after each line feed, and the end of a last line without one."""
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.nonzero(points == 10)[0] + 1
    return ends if not len(points) or points[-1] == 10 else np.append(ends, len(points))


def arrange(text: str, key: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, code points of prefix and middle (None if plain) and output of one text."""
    ends = Boundaries(line_ends(text))
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, last = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < spm_rate:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n, form, prefix_chars, middle_chars and output, replaced where they exist.

    A text is cut at two line ends (``[^\\n]*\\n|[^\\n]+``, code points) that the checksum of ``seed:key`` chooses, and written as
    prefix-suffix-middle (psm) or suffix-prefix-middle (spm). ``rate`` percent of the texts are cut, of which ``spm_rate`` percent as spm;
    texts that are null or empty (n = 0), that contain a mark, or that the rate leaves out stay plain: output is the text, lengths are null.
    Rows are independent: repeated rows and rows that share a key get the same choice, a null key counts as the empty one, empty tables
    give no rows. Very long texts are cut whole; a task holds one document beside the few megabytes it sends at once. No shuffle.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    plain = [f"c{k}" for k in range(len(names))]  # names with dots do not travel
    sent = docs.select(*[named(c).alias(p) for c, p in zip(names, plain)], F.coalesce(named(key).cast("string"), F.lit("")).alias("key"),
                       F.coalesce(named(text), F.lit("")).alias("body"))
    types = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*sent.schema.fields[:-2], *[T.StructField(c, t) for c, t in zip(made, types)]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies, low = batch.column(len(names)), batch.column(len(names) + 1), 0
            while low < batch.num_rows:
                rows, high, size = [], low, 0
                while high < batch.num_rows and size < MOST_TEXT_BYTES:
                    rows.append(arrange(bodies[high].as_py(), keys[high].as_py(), seed, rate, spm_rate))
                    size, high = size + len(rows[-1][4]), high + 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*[c.slice(low, high - low) for c in batch.columns[:len(names)]], *columns], names=[*plain, *made])
                low = high

    return sent.mapInArrow(cut, schema).select(*[F.col(p).alias(c) for c, p in zip(names, plain)], *made)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. No text that was cut contains a mark, so each mark occurs once."""
    whole = F.col(output)

    def body(begin: str, end: str | None) -> Column:
        after = F.substring_index(whole, begin, -1)
        return after if end is None else F.substring_index(after, end, 1)

    middle = body(MIDDLE, None)
    return (F.when(F.col(form) == "psm", F.concat(body(PREFIX, SUFFIX), middle, body(SUFFIX, MIDDLE)))
            .when(F.col(form) == "spm", F.concat(body(PREFIX, MIDDLE), middle, body(SUFFIX, PREFIX))).otherwise(whole))


def sql(seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    h = [f"CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)" for k in range(4)]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units FROM d),
c AS (SELECT *, len(units) AS n, {h[0]} % (len(units) + 1) AS a, {h[1]} % (len(units) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {h[2]} % 100 >= {rate} THEN 'plain'
    WHEN {h[3]} % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(units[1:least(a, b)], '') AS pre, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS mid,
  array_to_string(units[greatest(a, b) + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
