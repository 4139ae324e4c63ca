"""One query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spelltally.llm import (
    centroids,
    chosen_path,
    decontamination,
    deobfuscation,
    importance,
    language_model,
    licences,
    minhash,
    mixing,
    quality,
    quotations,
    sharding,
    simhash,
)
from spelltally.llm.common import table, whole

SHARDS = 40


def sharded(spark: SparkSession, folder: str) -> DataFrame:
    text = whole()
    docs = table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shard(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def licences_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of their source, at every depth of its folders; every fourth is named like a licence file."""
    steps = [F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100, 10)]
    depth = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)), F.lit(0)).cast("int")
    name = F.when(F.pmod(F.col("doc_id"), F.lit(4)) == 0, F.lit("LICENSE-")).otherwise(F.lit("file-"))
    files = table(spark, folder, "documents", "doc_id", "text", "source").select(
        F.concat_ws(
            "/", F.coalesce("source", F.lit("none")), F.slice(F.array(*steps), F.lit(1), depth), F.concat(name, F.col("doc_id").cast("string"))
        ).alias("path"),
        "text",
    )
    found = licences.scan(files)
    return found.withColumn("doc_id", F.regexp_extract("path", r"-(-?\d+)$", 1).try_cast("long"))


def reply_order(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written as mail, and linked again by what they quote."""
    chats = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return quotations.linked(quotations.as_mail(chats)).drop("text")


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    labels = table(spark, folder, "labels", "doc_id", "quality")
    return quality.score_quality(docs, labels).drop("text")


def language_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(table(spark, folder, "documents", "doc_id", "text"), settled=True)


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).drop("text")


def leaked(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontamination.leaks(docs, table(spark, folder, "benchmark", "item_id", "text"))


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    labels = table(spark, folder, "labels", "doc_id", "toxic")
    return deobfuscation.score_toxicity(docs, labels).drop("text")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    made = minhash.fingerprinted(table(spark, folder, "documents", "doc_id", "text"))
    return made.withColumns({name: F.lower(F.hex(name)) for name in ("fingerprint", "edited_fingerprint")})


def resampled(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    made = importance.scored(docs, table(spark, folder, "benchmark", "text"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


def clustered(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clustered(table(spark, folder, "embeddings", "vec_id", "embedding")).drop("computed")


def set_joined(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.joined(table(spark, folder, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_documents": sharded,
    "op2_licences": licences_of_files,
    "op3_quality_scores": quality_scores,
    "op4_language_scores": language_scores,
    "op5_mix_sources": mixed,
    "op6_benchmark_leaks": leaked,
    "op7_reply_order": reply_order,
    "op8_toxicity_scores": toxicity_scores,
    "op9_fingerprints": fingerprints,
    "op10_near_copies": near_copies,
    "op11_target_resampling": resampled,
    "op12_cluster_vectors": clustered,
    "op13_set_near_copies": set_joined,
}
ORACLE: dict[str, str] = {"op12_cluster_vectors": centroids.sql()}
