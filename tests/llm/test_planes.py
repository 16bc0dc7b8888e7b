"""Token-id files: ids against the tokenizers library, exact round trips, order, and reading by the chunk index."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventloom.llm import planes, registry
from eventloom.llm.common import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", " ", "　", "​", "﻿", "a", "B", "the", "Hello", "'s", "'ll", "'", "''",
         "don't", "9", "12", "é", "ß", "ª", "º", "µ", "×", "́", "漢", "字", "م", "😀", "!", "...", "-", "_", "²", "½", "“", "”", "…", "«", "<|endoftext|>", "᠎", "\x00"]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=5)), max_size=20))
def test_ids_equal_the_library(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    want = library_ids(text)
    assert np.frombuffer(planes.shared_coder(PATH).encode(text), "<u4").tolist() == want


def library_ids(text, own=library()):
    return own.encode(text, add_special_tokens=False).ids


def test_windows(monkeypatch):
    """A text cut into windows anywhere, and a piece longer than a window."""
    monkeypatch.setattr(planes, "WINDOW", 9)
    rng, coder = random.Random(3), planes.Coder(PATH)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS[:-3]) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library_ids(text)
    assert np.frombuffer(coder.encode("x" * 500), "<u4").tolist() == library_ids("x" * 500)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=12), st.integers(1, 20), st.booleans())
def test_file_round_trip(docs, block, bits):
    sink = io.BytesIO()
    writer = planes.Writer(sink, block, bits)
    for k, ids in enumerate(docs):
        writer.add(f"k{k}", np.array(ids, "<u4").tobytes())
    writer.close()
    reader = planes.Reader(sink, len(sink.getvalue()))
    got = [(k, low, np.frombuffer(ids, "<u4").tolist()) for k, low, ids in reader.documents()]
    assert got == [(f"k{k}", sum(map(len, docs[:k])), ids) for k, ids in enumerate(docs)]
    flat = [i for ids in docs for i in ids]
    low, high = len(flat) // 3, 2 * len(flat) // 3
    assert np.frombuffer(reader.ids(low, high), "<u4").tolist() == flat[low:high]


def test_damage_is_found():
    sink = io.BytesIO()
    writer = planes.Writer(sink, 4)
    writer.add(1, np.arange(9, dtype="<u4").tobytes())
    writer.close()
    whole = sink.getvalue()
    with pytest.raises(ValueError):
        planes.Reader(io.BytesIO(whole[:-1]), len(whole) - 1)
    reader = planes.Reader(io.BytesIO(whole), len(whole))
    reader.chunks[1][2] ^= 1
    assert np.frombuffer(reader.ids(0, 4), "<u4").tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        reader.ids(4, 6)


TEXTS = [None, "", " \n", "plain words here", "don't stop<|endoftext|>now", "漢字 and é", "word " * 90_000, "x" * 70_000, "same", "same"]


def expected(rows):
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library_ids(text or ""), 0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, tmp_path):
    """Nulls, empty and very long texts, an added token, repeated rows, clashing names, an empty table."""
    rows = [(k * 3 % 31, t) for k, t in enumerate(TEXTS * 3)] + [(None, "same"), (None, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("key", "ids", "start", "part", "path", "hash", "draw")])
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.op11_token_ids(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)
    df.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert registry.op11_token_ids(spark, str(tmp_path)).count() == 0


def test_one_id_in_a_third_of_the_rows(spark):
    """Rows of a hot key, equal ones included, lie in several files, one after the other."""
    rows = [(k, f"text {k}.") for k in range(200)] + [(50, "hot row")] * 60 + [(50, f"hot {k}") for k in range(60)]
    scratch = Scratch(spark)
    files = scratch.keep(planes.write(spark.createDataFrame(rows, "doc_id long, text string"), f"{scratch.root}/ids", PATH, block=64, bits=True))
    back = planes.read(spark, files, spark.createDataFrame(rows, "doc_id long, text string").schema["doc_id"].dataType).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == sorted(r[0] for r in rows)
    assert [r["start"] for r in back] == np.cumsum([0, *[len(r["ids"]) // 4 for r in back]])[:-1].tolist()
    want = sorted((k, tuple([*library_ids(t), 0])) for k, t in rows)
    assert sorted((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in back) == want
    assert files.where("n_docs > 200").count() == 0


def test_text_keys(spark):
    scratch = Scratch(spark)
    df = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "none")], "name string, body string")
    files = scratch.keep(planes.write(df, f"{scratch.root}/ids", PATH, key="name", text="body", end_id=50256))
    back = planes.read(spark, files, df.schema["name"].dataType, key="name").orderBy("start").collect()
    assert [r["name"] for r in back] == [None, "a", "b"]
    assert np.frombuffer(back[1]["ids"], "<u4").tolist() == [*library_ids("one"), 50256]
