"""Admission against the store: exact whatever the filters say, each folder opened only where it may matter, repeats harmless."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.streaming import admission

SCHEMA = "seq long, event_id string, url string, title string"


def rows(seed, n, span):
    rng = random.Random(seed)
    return [(seed * 1000 + k, rng.choice([f"e{rng.randint(0, span)}", f"e{rng.randint(0, span)}", None, ""]),
             rng.choice([f"https://x/{rng.randint(0, span)}", "#", None, ""]), f"t{k}") for k in range(n)]


def admitted(batches):
    """Row by row: ids are settled first within a batch, then links."""
    ids, links, out = set(), set(), []
    for k, batch in enumerate(batches):
        new = [r for r in batch if (not r[1] or r[1] not in ids) and (r[2] in (None, "", "#") or r[2] not in links)]
        seen, first = set(), []
        for r in sorted(new):
            if not r[1] or r[1] not in seen:
                first.append(r)
                seen.add(r[1])
        seen, kept = set(), []
        for r in first:
            if r[2] in (None, "", "#") or r[2] not in seen:
                kept.append(r)
                seen.add(r[2])
        ids |= {r[1] for r in kept if r[1]}
        links |= {r[2] for r in kept if r[2] not in (None, "", "#")}
        out += [(*r, k) for r in kept]
    return sorted(out)


def test_batches_against_a_plain_loop(spark, tmp_path):
    root, batches = str(tmp_path / "t"), [rows(k, 60, 80) for k in range(1, 4)]
    for k, batch in enumerate(batches):
        n = admission.admit_batch(spark, root, k, spark.createDataFrame(batch, SCHEMA), ("seq",))
        assert n == sum(r[-1] == k for r in admitted(batches))
    got = sorted(tuple(r) for r in admission.read(spark, root).select("seq", "event_id", "url", "title", "batch").collect())
    assert got == admitted(batches)
    assert admission.admit_batch(spark, root, 1, spark.createDataFrame(rows(9, 60, 500), SCHEMA), ("seq",)) == 0
    assert admission.read(spark, root).count() == len(got)


def test_filters_have_no_misses_and_few_false_alarms(spark):
    keys = admission._keys(spark.range(20_000).select(F.col("id").cast("string").alias("event_id"), F.lit("#").alias("url")))
    filters = admission._filters(keys).withColumn("batch", F.lit(0))
    n = F.size("words")

    def share(asked):
        met = asked.join(filters, "cell")
        for p in range(admission.PROBES):
            bit = admission._place(p, n)
            met = met.where(F.getbit(F.element_at("words", (F.floor(bit / 64) + 1).cast("int")), (bit % 64).cast("int")) == 1)
        return met.count()

    assert share(keys) == 20_000
    others = admission._keys(spark.range(50_000, 70_000).select(F.col("id").cast("string").alias("event_id"), F.lit("#").alias("url")))
    assert share(others) < 400


def test_a_broken_batch_is_written_anew(spark, tmp_path, monkeypatch):
    root, first, second = str(tmp_path / "t"), rows(1, 30, 40), rows(2, 30, 40)
    admission.admit_batch(spark, root, 0, spark.createDataFrame(first, SCHEMA), ("seq",))

    def broken(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(admission, "_filters", broken)
    with pytest.raises(RuntimeError):
        admission.admit_batch(spark, root, 1, spark.createDataFrame(second, SCHEMA), ("seq",))
    monkeypatch.undo()
    assert admission.read(spark, root).where("batch = 1").count() == 0
    admission.admit_batch(spark, root, 1, spark.createDataFrame(second, SCHEMA), ("seq",))
    got = sorted(tuple(r) for r in admission.read(spark, root).select("seq", "event_id", "url", "title", "batch").collect())
    assert got == admitted([first, second])
