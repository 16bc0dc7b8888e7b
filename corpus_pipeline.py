"""A corpus pipeline: language, repeated lines, near duplicates, benchmark passages, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, decontam, langid, linededup, simhash
from eventloom.llm.common import Scratch, named, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; lang becomes the language predicted from the text.

    The network learns from the rows that have a language; without any, lettered documents stay as they are.
    """
    if docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).isEmpty():
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.predict(docs, langid.fit(docs)).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else named(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more characters held by three or more documents stay in the largest id only; n_chars follows the new text."""
    out = linededup.drop_lines(docs)
    lengths = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {}
    return out.select(*[lengths.get(c, named(c)) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark passages go."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to."""
    import public_tokenizers
    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [("language_id", language), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
                                   ("benchmark_decontamination", decontamination), ("bpe_encoding", tokens)]
ORACLE_SQL = None  # trained networks, fingerprints and merges have no SQL; tests hold the stages against brute force


def small_batches(stage: Stage) -> Stage:
    """Whole texts go to Python workers a few megabytes at a time, so that their memory does not grow from stage to stage; the session
    keeps the setting, for a stage's frame is evaluated later."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, small_batches(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
