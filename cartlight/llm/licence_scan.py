"""Licence scans by canonical digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartlight.llm.licences import DIGESTS, KNOWN, SPELLINGS
from cartlight.llm.scratch import Scratch

# A line that only says whose copyright it is: it may differ between copies of one licence.
_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\p{L}\n]*(\(c\)|©|[0-9]{4})[^\n]*$"
# Owners before or without a year, for the look-up of whole texts alone: the digest that is returned keeps such lines.
_OWNER_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:(?i:copyright)[ \t][^\n]*\b(?:19|20)[0-9]{2}\b[^\n]*"
    r"|Copyright(?:[ ,]+(?!Licen|Holder|Notice|Right|Law|Act|Owner|Statement)\p{Lu}[\p{L}\p{N}.'&-]*)+[^\p{L}\n]*)$"
)


def canonical(text: Column) -> Column:
    """A licence text with case, punctuation, white space, copyright lines and equivalent spellings made alike."""
    plain = F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, " ")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)


def known_licences(spark: SparkSession) -> DataFrame:
    """(digest, licence) of the known texts."""
    known = spark.createDataFrame(KNOWN, "licence string, text string")
    digest = F.sha2(canonical(F.col("text")), 256).alias("digest")
    longer = spark.createDataFrame(DIGESTS, "licence string, digest string").select("digest", "licence")
    return known.select(digest, "licence").unionByName(longer).groupBy("digest").agg(F.min("licence").alias("licence"))


def licence_scan(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, licence, notices, n_notices of every row of ``documents``.

    ``digest`` is that of the whole canonical text, ``licence`` the known licence with that digest, or with that
    of the text without lines that name an owner, else null.
    ``notices`` are the known licences, sorted and parted by commas, whose whole text is one line of the document;
    ``n_notices`` counts such lines. ``known`` is a table (digest, licence), one row a digest; by default the texts
    of ``licences.KNOWN`` and ``licences.DIGESTS``.

    Only built-in expressions run: digests are joined by hash, lines drop out of the scan unless they are known, and no
    text is shuffled. The default table has a fixed size and is broadcast; Spark chooses for others.

    A null or empty text, or one of punctuation alone, has the digest of the empty text and no licence. Rows with
    equal doc_id and text get the same result; a null doc_id is kept.
    """
    spark = documents.sparkSession
    Scratch(spark, "licence-scan")
    known = F.broadcast(known_licences(spark)) if known is None else known
    known = known.filter(F.col("digest") != F.sha2(F.lit(""), 256))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("_text"),
        text.alias("_t"), F.sha2(canonical(text), 256).alias("digest"),
    ).withColumn("_own", F.when(
        F.col("_t").rlike(_OWNER_LINE), F.sha2(canonical(F.regexp_replace("_t", _OWNER_LINE, " ")), 256)
    ).otherwise(F.col("digest"))).drop("_t").join(known.withColumnRenamed("digest", "_own"), "_own", "left")
    lines = documents.select(
        F.col("doc_id").cast("bigint").alias("_doc"), F.xxhash64(text).alias("_line_text"),
        F.posexplode(F.split(text, "\n", -1)).alias("at", "line"),
    )
    found = lines.withColumn("digest", F.sha2(canonical(F.col("line")), 256)).join(known, "digest").select(
        "_doc", "_line_text", "at", "licence"
    ).distinct().groupBy("_doc", "_line_text").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"),
        F.count(F.lit(1)).alias("n_notices"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_line_text"))
    return rows.join(found, same, "left").select(
        "doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
    )
