"""Queries of this package and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fim, hnsw, langid, linededup, pii, planes, sharding, simhash, substring, toxicity, turns
from .common import Scratch, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(sharding.shard_sql(8))
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)


@query(linededup.SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query(substring.SQL)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.cut_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    coded = bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query(decontam.SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query(hnsw.SQL)
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"))


def fold(parts: int, out: int) -> Column:
    """Whether a document is held out: the checksum of its id, written as text, leaves ``out``; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == out, F.lit(False)).alias("held_out")


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", fold(3, 1))
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~fold(3, 1))
    scored = toxicity.score(docs, toxicity.fit(docs.where("NOT held_out"), labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold(4, 2))
    return langid.predict(docs.select("doc_id", "text", "held_out"), langid.fit(docs.where("NOT held_out"))).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents").select("doc_id", "text")
    files = scratch.keep(planes.write(docs, f"{scratch.root}/ids", public_tokenizers.path("byte_bpe_50k.json")))
    back = planes.read(spark, files, docs.schema["doc_id"].dataType)
    return back.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query(fim.sql())
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(fim.restored().cast("binary"), 256).alias("restored_sha256"))


@query(turns.sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = turns.repair(turns.damage(read(spark, sf_dir, "conversations")), absent="absent")
    return fixed.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))
