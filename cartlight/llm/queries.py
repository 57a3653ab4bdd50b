"""Registered queries of the text operators, with the parameters they run with in production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartlight.llm.conversation_repair import conversation_repairs, damage
from cartlight.llm.decontaminate import contamination
from cartlight.llm.embedding_dedup import embedding_dedup
from cartlight.llm.hard_negatives import hard_negatives
from cartlight.llm.licence_scan import licence_scan
from cartlight.llm.line_dedup import line_dedup
from cartlight.llm.ngram_join import ngram_join
from cartlight.llm.packing import best_fit_pack, token_pieces
from cartlight.llm.pii import replace_pii
from cartlight.llm.quality import quality
from cartlight.llm.scratch import Scratch
from cartlight.llm.secret_scan import KINDS, secret_scan
from cartlight.llm.substring_dedup import repeated_substrings
from cartlight.llm.token_counts import token_counts

# The key of the registered query. A real run takes its own, kept secret.
PII_KEY = b"registered query"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(_table(spark, folder, "documents"), width=3, num=90, den=100)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    pieces = token_pieces(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return best_fit_pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048, scratch)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(_table(spark, folder, "documents")).select(
        "doc_id", "dedup.n_lines", "dedup.n_removed", "dedup.n_spans",
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup(_table(spark, folder, "embeddings"), least=0.95)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"), threshold=0.3)


def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licence_scan(_table(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return repeated_substrings(_table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    replaced = replace_pii(_table(spark, folder, "documents"), PII_KEY)
    return replaced.select(
        "doc_id", F.size("entities").cast("bigint").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(
        vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0, scale=256, positives=5, negatives=3, low=50, high=95
    )


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repairs(damage(_table(spark, folder, "conversations")), F.col("present"))


def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return secret_scan(_table(spark, folder, "documents")).select(
        "doc_id", *[of_kind(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_packing": op2_packing,
        "op3_line_dedup": op3_line_dedup,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_quality": op5_quality,
        "op6_licence_scan": op6_licence_scan,
        "op7_decontamination": op7_decontamination,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_pii": op9_pii,
        "op10_token_counts": op10_token_counts,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_secret_scan": op13_secret_scan,
    }
