"""Fill-in-middle: containers against sorted lists, outputs against plain slicing, exact round trips."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import fim, registry


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300_000), min_size=1, max_size=60), st.integers(0, 200_000), st.integers(0, 9000), st.integers(1, 3))
def test_select(scattered, start, length, step):
    values = np.array(sorted(scattered | set(range(start, start + length * step, step))), np.int64)
    found = fim.Boundaries(values)
    assert len(found) == len(values)
    for k in {0, len(values) - 1, *range(0, len(values), max(1, len(values) // 50))}:
        assert found.select(k) == values[k]


def test_all_three_containers():
    rng = np.random.default_rng(1)
    dense = np.sort(rng.choice(65536, 20_000, replace=False))
    values = np.concatenate([np.array([3, 70, 900]), 65536 + dense, 2 * 65536 + np.arange(30_000)])
    found = fim.Boundaries(values)
    assert [c[0] for c in found.containers] == ["array", "bitmap", "run"]
    assert [found.select(k) for k in range(0, len(values), 7)] == values[::7].tolist()


def plain(text, key):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (text,)][0]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (n, "plain", None, None, sha, sha)
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return (n, form, len(pre), len(mid), hashlib.sha256(out.encode()).hexdigest(), sha)


TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "tail <", "x <S\n>y", "has <M> mark\nand", "é漢😀\nñ\n😀", "<\n<P\nS>\n",
         "\n".join(f"line {i}" for i in range(90_000)), "\n" * 70_000 + "end", "z" * 300_000, "\r\n \x85\x0b\n"]


def test_query(spark, tmp_path):
    """Nulls, empty and very long texts, marks, repeated rows and keys, clashing names, an empty table."""
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(5, "a\nb\nc"), (5, "a\nb\nc"), (5, "other\nrow\n"), (None, "null\nkey\n"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("n", "form", "output", "key", "body", "c0")])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in registry.op12_fill_in_middle(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((k, *plain(t, k)) for k, t in rows), key=repr)
    kept = fim.transform(df)
    assert sorted(kept.columns) == sorted(["doc_id", "text", "key", "body", "c0", "n", "form", "prefix_chars", "middle_chars", "output"])
    assert kept.where(~fim.restored().eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    df.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert registry.op12_fill_in_middle(spark, str(tmp_path)).count() == 0


def test_rates(spark):
    df = spark.createDataFrame([(k, "a\nb\n") for k in range(600)], "doc_id long, text string")
    forms = {r["form"]: r["count"] for r in fim.transform(df, rate=60, spm_rate=25).groupBy("form").count().collect()}
    assert 180 < forms["plain"] < 300 and forms["spm"] < forms["psm"]
