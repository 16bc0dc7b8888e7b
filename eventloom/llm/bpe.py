"""BPE encoding and decoding that reuses content-defined chunks."""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named

GEAR_BYTES, CUT_BITS = 8, 8  # a cut depends on the 8 bytes before it; a chunk has 256 bytes on average
# Bytes of a worker's memories: words, pieces of words, and chunks; longer words are not remembered, so an entry is bounded too
MOST_WORD_BYTES, MOST_CHUNK_BYTES, LONGEST_WORD, WORD_ENTRY = 56 << 20, 8 << 20, 32, 640
MOST_TEXT_BYTES = 1 << 20  # of texts whose results a task holds at once, beside one document


class Words(dict):
    """Entries of words, made when they are first asked for; a full memory is emptied. An entry of a word of at most LONGEST_WORD bytes
    or letters takes at most WORD_ENTRY bytes, all its objects and its place counted."""

    def __init__(self, make: Callable, most_bytes: int):
        super().__init__()
        self.make, self.most = make, max(1, most_bytes // WORD_ENTRY)

    def __missing__(self, key: bytes | str) -> tuple:
        entry = self.make(key)
        if len(key) <= LONGEST_WORD:
            if len(self) >= self.most:
                self.clear()
            self[key] = entry
        return entry


class Chunks(dict):
    """Entries of chunks, likewise, but counted in the bytes that each takes."""

    def __init__(self, make: Callable, most_bytes: int):
        super().__init__()
        self.make, self.most_bytes, self.held = make, most_bytes, 0

    def __missing__(self, key: bytes) -> tuple:
        entry = self.make(key)
        size = 104 + sys.getsizeof(key) + sys.getsizeof(entry) + sum(map(sys.getsizeof, entry))
        if self.held + size > self.most_bytes:
            self.clear()
            self.held = 0
        self[key] = entry
        self.held += size
        return entry


class ChunkCoder:
    """Encodes and decodes whole texts with a public vocabulary whose pre-tokenizer drops white space.

    A rolling hash over the last 8 bytes cuts a text into chunks, so equal passages of different documents have equal chunks. Each
    distinct chunk is encoded once while it is remembered. A cut may fall inside a word or a character, so a chunk gives only the words
    between its first and last white space; at a join the bytes from the last white space before to the first after it, over as many
    chunks as that takes, are encoded anew. White space always ends a token, so both sides agree with the encoding of the whole text.
    """

    def __init__(self, path: str, cut_bits: int = CUT_BITS, most_words: int = MOST_WORD_BYTES, most_bytes: int = MOST_CHUNK_BYTES):
        """``most_words`` and ``most_bytes`` bound the memories of words and pieces, and of chunks, in bytes."""
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        # texts are cut at white space, and plain words sent to the merges, only where the vocabulary's own steps are the known ones
        self.by_words = all(made.get(k) == v for k, v in _STEPS.items()) and made["model"]["type"] == "BPE"
        self.mask = np.uint64((1 << cut_bits) - 1)
        rng = np.random.default_rng(8)
        self.gear = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
        self.words, self.pieces = Words(self._word, most_words), Words(self._piece, most_words)
        self.chunks = Chunks(self._inner, most_bytes)
        self.used, self.made = 0, 0  # chunks met, and those that were encoded

    def cuts(self, body: bytes) -> list[int]:
        """Ends of the chunks."""
        n = len(body)
        if n <= GEAR_BYTES:
            return [n]
        values = self.gear[np.frombuffer(body, np.uint8)]
        rolled = np.zeros(n - GEAR_BYTES + 1, np.uint64)
        for k in range(GEAR_BYTES):
            rolled += values[k:n - GEAR_BYTES + 1 + k] >> np.uint64(k)
        ends = (np.nonzero((rolled >> np.uint64(20)) & self.mask == 0)[0] + GEAR_BYTES).tolist()
        return ends if ends and ends[-1] == n else [*ends, n]

    def whole_words(self, body: bytes) -> tuple[bytes, str]:
        """Ids (native unsigned 32-bit) and decoded text of bytes that begin and end at word ends."""
        found = list(map(self.words.__getitem__, body.split()))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])

    def _word(self, body: bytes) -> tuple[bytes, str]:
        """One word; marks after plain letters are a token run of their own, so the letters are shared by all such words."""
        letters = body.rstrip(_MARKS)
        if len(letters) < len(body) and (low := _lowered(letters.decode())):
            (a, b), (c, d) = self.pieces[low], self.pieces[body[len(letters):].decode()]
            return a + c, f"{b} {d}"
        text = body.decode()
        return self.pieces[_lowered(text) or text]

    def _piece(self, text: str) -> tuple[bytes, str]:
        """Lower-case Latin letters, which the normalizer and the pre-tokenizer leave whole, go to the merges at once."""
        if text.isalpha() and max(text) < "\u0250" and text.islower():
            ids = [t.id for t in self.merges.tokenize(text if text.isascii() else "".join([_OCTETS[b] for b in text.encode()]))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes(), self.tokenizer.decode(ids, skip_special_tokens=False)

    def _inner(self, chunk: bytes) -> tuple:
        """Head, tail, ids and text of what lies between the first and the last white space of a chunk; nothing if it has none."""
        self.made += 1
        spaced = chunk.translate(_SPACED)
        first = spaced.find(b" ")
        if first < 0:
            return ()
        last = spaced.rfind(b" ")
        return (chunk[:first], chunk[last + 1:], *self.whole_words(chunk[first:last]))

    def code(self, body: bytes) -> tuple[bytes, str]:
        if not self.by_words:
            ids = self.tokenizer.encode(body.decode(), add_special_tokens=False).ids
            return array("I", ids).tobytes(), self.tokenizer.decode(ids, skip_special_tokens=False)
        ids, texts, join, at = [], [], [], 0
        for end in self.cuts(body):
            chunk, at = body[at:end], end
            self.used += 1
            got = self.chunks[chunk]
            if not got:
                join.append(chunk)
                continue
            head, tail, own_ids, own_text = got
            if join or head:
                more, text = self.whole_words(b"".join([*join, head]))
                ids.append(more)
                if more:
                    texts.append(text)
            ids.append(own_ids)
            if own_ids:
                texts.append(own_text)
            join = [tail] if tail else []
        if join:
            more, text = self.whole_words(b"".join(join))
            ids.append(more)
            if more:
                texts.append(text)
        return b"".join(ids), " ".join(texts)


def _lowered(text: str) -> str | None:
    """Latin letters in lower case, which no step before the merges changes or cuts; None for any other text."""
    return low if text.isalpha() and max(text) < "\u0250" and (low := text.lower()).isalpha() else None


@lru_cache(1)
def shared_coder(path: str) -> ChunkCoder:
    """One coder, and its memories, for all tasks of a worker."""
    return ChunkCoder(path)


# The steps around the merges of the vocabulary that the cuts at white space are made for
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "decoder": None}
_MARKS = b".,;:!?%&*$#()"  # none of them joins the letters before it under the vocabulary's pattern
# How byte-level vocabularies write octets: printable ones as themselves, the rest from 256 on in order
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OCTETS = [chr(b if b in _SHOWN else 256 + sum(k not in _SHOWN for k in range(b))) for b in range(256)]
_SPACED = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ids (array<int>) and decoded (string) of every whole text, replaced where they exist.

    ids equal ``encode(text, add_special_tokens=False).ids`` of the tokenizers library, decoded its
    ``decode(ids, skip_special_tokens=False)``. Null and empty texts have no ids and decode to the empty text. No shuffle: chunks are
    shared by the documents that a worker codes, whose memories are bounded in bytes, and results leave a task after every megabyte of text.
    A vocabulary whose normalizer, pre-tokenizer or decoder are not the known ones is applied to whole texts by the library.
    ``path`` must be readable on every worker.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    plain = [f"c{k}" for k in range(len(names))]  # names with dots do not travel
    sent = docs.select(*[named(c).alias(p) for c, p in zip(names, plain)], named(text).cast("binary").alias("body"))
    schema = T.StructType([*sent.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared_coder(path)
        for batch in batches:
            bodies, low = batch.column(len(names)), 0
            while low < batch.num_rows:
                ids, lengths, decoded, high, size = [], [0], [], low, 0
                while high < batch.num_rows and size < MOST_TEXT_BYTES:
                    t = bodies[high]
                    body = t.as_buffer().to_pybytes() if t.is_valid else b""
                    got, back = coder.code(body)
                    ids.append(got)
                    lengths.append(lengths[-1] + len(got) // 4)
                    decoded.append(back)
                    high, size = high + 1, size + len(body)
                flat = np.frombuffer(b"".join(ids), np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([*[c.slice(low, high - low) for c in batch.columns[:len(names)]],
                                                  pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())],
                                                 names=[*plain, "ids", "decoded"])
                low = high

    return sent.mapInArrow(code, schema).select(*[F.col(p).alias(c) for c, p in zip(names, plain)], "ids", "decoded")
