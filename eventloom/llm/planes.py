"""Token ids in files: blocks of ids transposed into byte or bit planes, each plane compressed, found again by a chunk index."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16  # ids of a chunk
END_ID = 0
MOST_PIECES, LONGEST_PIECE = 300_000, 32  # of either half of a worker's memory of encoded pieces, about 60 MB each
WINDOW = 1 << 20  # code points of a text that are cut into pieces at once
MOST_OUT_BYTES = 4 << 20  # of ids that a reading task sends at once, beside one document

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS, _OTHERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", "\x00-\x08\x0e-\x1f!-/:-@\\[-`{-\x7f"
_AFTER = "(?=[\x00-\x7f\xab\xbb\xbf\u2010-\u2027]|\\Z)"  # no letter, digit or mark goes on here
# One token of the pre-tokenizer each: contractions, words, numbers, signs, single white space; then pieces of several tokens, in which a
# last white space goes with what follows it and the white space before that is a piece of its own
_PIECES = re.compile("|".join((
    "'(?:s|t|re|ve|m|ll|d)", f" ?[{_LETTERS}]++{_AFTER}", " ?[0-9]++(?=[\x00-\x7f]|\\Z)", f" ?[{_OTHERS}]++(?=[\x00-\x7f]|\\Z)",
    f"[\t-\r](?=[^{_SPACE}])", f"[{_SPACE}]?[^{_SPACE}]+", f"[{_SPACE}]+(?![^{_SPACE}])", f"[{_SPACE}]+")))
_WORD = re.compile(f" ?[{_LETTERS}]+|[!-~]")
# How byte-level vocabularies write octets: printable ones as themselves, the rest from 256 on in order
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OCTETS = [chr(b if b in _SHOWN else 256 + sum(k not in _SHOWN for k in range(b))) for b in range(256)]


class Coder(dict):
    """Whole texts to ids (little-endian unsigned 32-bit) with the tokenizers library.

    A byte-level pre-tokenizer cuts a text from left to right, and where it cuts depends on what follows only. So a text is cut into
    pieces of whole tokens, and the ids of short pieces are remembered: a full memory becomes the older half, from which pieces still in
    use come back. Words go to the library's merges at once. Texts that contain an added token, and files with another normalizer or
    pre-tokenizer, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cutter = made.get("pre_tokenizer") or {}
        by_pieces = (made.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
                     and not cutter.get("add_prefix_space") and made["model"]["type"] == "BPE" and not made["model"].get("ignore_merges"))
        self.whole = tuple(t["content"] for t in made.get("added_tokens", ())) if by_pieces else ("",)
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            if _WORD.fullmatch(piece):
                spelled = piece.replace(" ", _OCTETS[32]) if piece.isascii() else "".join([_OCTETS[b] for b in piece.encode()])
                ids = array("I", [t.id for t in self.merges.tokenize(spelled)]).tobytes()
            else:
                ids = self._ids(piece)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MOST_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _pieces(self, text: str) -> Iterator[list[str]]:
        at, width = 0, WINDOW
        while at + width < len(text):
            found, open_end = _PIECES.findall(text, at, at + width), 0
            while found and open_end < 3:  # the last piece may go on, a contraction may be cut
                open_end += len(found.pop())
            if not found:  # a piece fills the window
                width *= 2
                continue
            yield found
            at, width = at + width - open_end, WINDOW
        yield _PIECES.findall(text, at)

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.whole):
            return self._ids(text)
        return b"".join([b"".join(map(self.__getitem__, pieces)) for pieces in self._pieces(text)])


@lru_cache(1)
def shared_coder(path: str) -> Coder:
    """One memory of pieces for all tasks of a worker."""
    return Coder(path)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Four byte planes or 32 bit planes, lowest first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, k].tobytes() for k in range(4)]
    return [row.tobytes() for row in np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(rows, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one file: compressed planes of each chunk, then the index (chunks, keys and lengths of documents), its size and the mark.

    A chunk's entry is [offset, ids, crc32 of the ids, sizes of its planes]. Documents follow one another without regard to chunks.
    """

    def __init__(self, sink: BinaryIO, block: int = BLOCK, bits: bool = False):
        import zstandard
        self.sink, self.block, self.bits = sink, block, bits
        self.press = zstandard.ZstdCompressor(level=3)
        self.chunks: list = []
        self.keys: list = []
        self.lengths: list[int] = []
        self.held, self.size = bytearray(), len(MAGIC)
        sink.write(MAGIC)

    def add(self, key: Any, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.held += ids
        full = len(self.held) // (4 * self.block) * 4 * self.block
        for at in range(0, full, 4 * self.block):
            self._chunk(bytes(self.held[at:at + 4 * self.block]))
        del self.held[:full]

    def _chunk(self, raw: bytes) -> None:
        planes = [self.press.compress(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.bits)]
        self.chunks.append([self.size, len(raw) // 4, zlib.crc32(raw), [len(p) for p in planes]])
        for p in planes:
            self.sink.write(p)
            self.size += len(p)

    def close(self) -> None:
        if self.held:
            self._chunk(bytes(self.held))
        index = self.press.compress(json.dumps({"block": self.block, "bits": self.bits, "chunks": self.chunks, "keys": self.keys,
                                                "lengths": self.lengths}).encode())
        self.sink.write(index + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads ids of one file by the chunks that hold them."""

    def __init__(self, source: BinaryIO, size: int):
        import zstandard
        self.source, self.unpress = source, zstandard.ZstdDecompressor()
        tail = self._at(size - 8 - len(MAGIC), 8 + len(MAGIC))
        if tail[8:] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids, or not whole")
        length = int.from_bytes(tail[:8], "little")
        index = json.loads(self.unpress.decompress(self._at(size - 8 - len(MAGIC) - length, length)))
        self.block, self.bits, self.chunks, self.keys = index["block"], index["bits"], index["chunks"], index["keys"]
        self.ends = np.cumsum([0, *index["lengths"]])
        self.last: tuple[int, np.ndarray] | None = None

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def chunk(self, k: int) -> np.ndarray:
        if self.last is None or self.last[0] != k:
            offset, n, crc, sizes = self.chunks[k]
            raw, planes, at = self._at(offset, sum(sizes)), [], 0
            for length in sizes:
                planes.append(self.unpress.decompress(raw[at:at + length]))
                at += length
            ids = from_planes(planes, n, self.bits)
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"chunk {k} is damaged")
            self.last = (k, ids)
        return self.last[1]

    def ids(self, low: int, high: int) -> bytes:
        """Ids from position ``low`` to before ``high`` of the file."""
        parts = [self.chunk(k)[max(0, low - k * self.block):high - k * self.block].tobytes() for k in range(low // self.block, -(-high // self.block))]
        return b"".join(parts)

    def documents(self) -> Iterator[tuple[Any, int, bytes]]:
        """(key, position of the first id in the file, ids) in the order written."""
        for key, low, high in zip(self.keys, self.ends.tolist(), self.ends[1:].tolist()):
            yield key, low, self.ids(low, high)


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block: int = BLOCK,
          bits: bool = False) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of ``key`` (nulls first), one file a partition.

    Returns the files as (part, path, n_docs, n_ids); part numbers follow the order of the keys. Its evaluation writes the files: keep
    it (``Scratch.keep``) and read from what is kept. Each attempt of a task writes a file of its own name and only those of successful
    attempts are returned, so lost or repeated tasks leave files that nobody reads. ``folder`` is a URI that pyarrow can write (file, hdfs,
    s3, gs) on every worker; ``tokenizer`` is readable on every worker. Keys are integers or strings.

    Null and empty texts have the end id only. Rows that share a key lie side by side, ordered by their text; equal rows are repeated.
    Empty tables give no file. A hot key is split over files by its texts' hash, equal rows by a seeded draw. A very long text is cut
    into pieces window by window; its ids are held once.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(named(key).alias("key"), F.coalesce(named(text), F.lit("")).alias("body"), F.xxhash64(named(text)).alias("hash"), F.rand(11).alias("draw"))
    dealt = sent.repartitionByRange(partitions, "key", "hash", "draw").sortWithinPartitions("key", "hash", "body").select("key", "body")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext
        writer = None
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                if writer is None:
                    part = TaskContext.get().partitionId()
                    path, coder, end = f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids", shared_coder(tokenizer), np.array([end_id], "<u4").tobytes()
                    fs, place = FileSystem.from_uri(path)
                    fs.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(place)
                    writer = Writer(sink, block, bits)
                writer.add(k.as_py(), coder.encode(t.as_py()) + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(writer.keys), "n_ids": sum(writer.lengths)}],
                                             schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return dealt.mapInArrow(store, "part int, path string, n_docs long, n_ids long")


def read(spark: SparkSession, files: DataFrame, key_type: T.DataType, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of every document in ``files`` (see ``write``): start counts all ids before it, ids are little-endian 32-bit.

    The running sum goes over the list of files, one row each. A task holds one chunk and the documents it sends at once.
    """
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.select("path", base.alias("base")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    schema = T.StructType([T.StructField("key", key_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    typed = pa.string() if isinstance(key_type, T.StringType) else pa.int64()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        def sent(rows: list) -> pa.RecordBatch:
            keys, starts, ids = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(keys, typed), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["key", "start", "ids"])

        for batch in batches:
            for row in batch.to_pylist():
                fs, place = FileSystem.from_uri(row["path"])
                with fs.open_input_file(place) as source:
                    rows, held = [], 0
                    for k, low, ids in Reader(source, source.size()).documents():
                        rows.append((k, row["base"] + low, ids))
                        held += len(ids)
                        if held >= MOST_OUT_BYTES:
                            yield sent(rows)
                            rows, held = [], 0
                    if rows:
                        yield sent(rows)

    wide = T.StructType([T.StructField("key", T.StringType() if isinstance(key_type, T.StringType) else T.LongType()), *schema.fields[1:]])
    return listed.mapInArrow(load, wide).select(F.col("key").cast(key_type).alias(key), "start", "ids")
