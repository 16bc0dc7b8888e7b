"""The corpus pipeline against plain Python, on whole rows, repeated rows, nulls and empty tables."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm import PASSAGE, TEXTS, edges, slow_fingerprint, slow_report

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, row string, ids string"
ITEMS = [(1, PASSAGE), (2, "a short item"), (3, None), (4, "")]


def slow_lines(rows):
    """{position: text} after line de-duplication of (id, text) rows."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 20:
                    holders[key(line)].add(i)
    drop = {k: max(ids) for k, ids in holders.items() if len(ids) >= 3}
    return ["\n".join(x for x in (t or "").split("\n") if i is None or drop.get(key(x), i) == i) for i, t in rows]


def slow_keep(rows):
    named = [(i, slow_fingerprint(t)) for i, t in rows if i is not None]
    part = edges([(a, b) for a, f in named for b, g in named if bin(f ^ g).count("1") <= 3])
    out, taken = [], set()
    for i, t in rows:
        if i is None or (part.get(i, i) == i and i not in taken):
            out.append((i, t))
            taken.add(i)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    texts = [*TEXTS, "%&*$# 123 ...", "12.5", *[f"unique text {i} with some words of its own {i * 7} and a tail {i * i}" for i in range(30)],
             *[f"common header line of this site\nbody {i} is about topic {i * 13} only\ncommon footer line of this site" for i in range(6)],
             PASSAGE, f"intro words {PASSAGE}"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "src", None if t is None else len(t), "own", "own", "own") for i, t in enumerate(texts)]
    rows += [(5, TEXTS[5], "en", "src", 3, "own", "own", "own"), (None, TEXTS[5], None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, expected = docs.columns, [(r["doc_id"], r["text"]) for r in docs.collect()]
    steps = {
        "language_id": lambda rows: [(i, t) for i, t in rows if re.search(r"[^\W\d_]", t or "")],
        "line_dedup": lambda rows: [(i, t) for (i, _), t in zip(rows, slow_lines(rows))],
        "simhash_near_dedup": slow_keep,
        "benchmark_decontamination": lambda rows: [r for r, bad in zip(rows, slow_report(rows, ITEMS)) if not bad[4]],
    }

    def plain(rows):
        return sorted((i is None, i or 0, t or "") for i, t in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns, name
        before = len(expected)
        expected = steps[name](expected)
        kept = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert plain(kept) == plain(expected), name
        assert name == "line_dedup" or len(expected) < before
        path = f"{folder}/stage-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.where("n_chars <> length(text)").count() == 0
    import public_tokenizers
    from tokenizers import Tokenizer
    plain_tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i is None, i or 0, plain_tokens.encode(t, add_special_tokens=False).ids) for i, t in expected)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in last) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in last)
    ran = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in ran) == want


def test_stages_on_empty_tables(spark, folder, tmp_path):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    spark.read.parquet(f"{folder}/benchmark.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    full = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.decontamination(spark, full, str(tmp_path)).count() == full.count()
