"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents, whatever their names; ``n_chars`` follows the text. ``run`` writes every result as Parquet to the
checkpoint folder and reads it again. Rows are told apart by themselves, not by their doc_id, which may be null or repeated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cartlight.functions.ranking import is_small
from cartlight.llm.decontaminate import decontaminate
from cartlight.llm.line_dedup import line_dedup
from cartlight.llm.ngram_join import ngram_join
from cartlight.llm.packing import best_fit_pack, token_pieces
from cartlight.llm.quality import fit_quality, score_quality
from cartlight.llm.rows import others, restored
from cartlight.llm.scratch import Scratch

TOKENIZER = "word_bpe_49k.json"


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labels, does not reject."""
    Scratch(spark, "stage-quality")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(score_quality(docs, model).filter("score >= 0.3"), docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows removed; a document that loses every line goes."""
    cut = line_dedup(docs.select("doc_id", "text", others(docs)))
    return _counted(restored(cut.filter("dedup.n_removed < dedup.n_lines or dedup.n_lines = 0"), docs.columns))


def _numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(id, row, text), the ids different and the same however often and wherever the rows are read.

    Rows of Parquet files have the number of their file and their place in it, so that their texts need not be written
    again; rows of anything else, or of more files than a broadcast may hold, are written with their numbers.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        places = docs.select(others(docs), "text", meta["file_path"].alias("file"), meta["row_index"].alias("at"))
        files = places.select("file").distinct()
    except AnalysisException:  # no files
        return scratch.keep(docs.select(F.monotonically_increasing_id().alias("id"), others(docs), "text"), "numbered")
    files = scratch.keep(files.withColumn("n", F.row_number().over(Window.orderBy("file")).cast("bigint")), "files")
    if not is_small(files):
        return scratch.keep(docs.select(F.monotonically_increasing_id().alias("id"), others(docs), "text"), "numbered")
    return places.join(F.broadcast(files), "file").select((F.shiftleft("n", 40) + F.col("at")).alias("id"), "row", "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at 0.8 by five-word shingles, one with the smallest doc_id (with none, if none has one)."""
    scratch = Scratch(spark, "stage-ngram-join")
    numbered = _numbered(scratch, docs)
    groups = ngram_join(numbered.select(F.col("id").alias("doc_id"), "text"), width=5, num=8, den=10)
    named = groups.select(F.col("doc_id").alias("id"), "component_id").join(
        numbered.select("id", F.col("row.doc_id").alias("doc_id")), "id")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "id")
    first = scratch.keep(named.groupBy("component_id").agg(F.min(place).alias("f")).select("f.id"), "first")
    return restored(numbered.join(first.hint("merge"), "id", "left_semi"), docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items removed; a document that consists of them by more than half goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate(docs, benchmark, window=10, max_coverage=0.5))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048."""
    pieces = token_pieces(docs, public_tokenizers.path(TOKENIZER), 2048)
    return best_fit_pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]

# The classifier cannot be said in SQL, and all later stages work on what it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        before = docs
    return docs
