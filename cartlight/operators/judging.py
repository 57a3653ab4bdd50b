"""How well scores tell customers apart: exact ranking figures from counts per score, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartlight.operators import churn
from cartlight.session import materialize
from cartlight.tables import Tables

# Parts of the range of the scores that running sums go over first: a table with so many rows at most.
_PARTS = 1 << 16


def score_counts(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg, pos_above, neg_above) for every distinct score: rows at it, and rows with a higher one.

    ``label`` is 1 or 0; rows without score (NULL, NaN) or label are left out. Counts are added in the map tasks, so a
    score that a third of the rows share is one row. Running sums go over at most 65,536 parts of the score's range, then
    over the distinct scores within a part.
    """
    value = F.col(score).cast("double")
    known = scored.filter(value.isNotNull() & ~F.isnan(value) & F.col(label).isin(0, 1))
    counts = materialize(known.groupBy(value.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))
    low, high = counts.agg(F.min("score")).scalar(), counts.agg(F.max("score")).scalar()
    part = F.coalesce(F.floor(F.try_divide(F.col("score") - low, high - low) * (_PARTS - 1)), F.lit(0))
    counts = materialize(counts.withColumn("part", part))
    sums = counts.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    higher = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    above = materialize(sums.select(
        "part", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_before") for c in ("p", "n")]))
    inside = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)

    def over(column: str, before: str) -> Column:
        return F.coalesce(F.sum(column).over(inside), F.lit(0)) + F.col(before)

    return counts.join(above, "part").select(
        "score", "pos", "neg", over("pos", "p_before").alias("pos_above"), over("neg", "n_before").alias("neg_above"))


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row: positives, negatives and the exact area under the ROC curve, equal scores counted by half.

    The area is NULL without rows of both kinds.
    """
    counts = score_counts(scored, score, label)
    won = (2 * F.col("pos_above") + F.col("pos")).cast("decimal(20,0)") * F.col("neg").cast("decimal(18,0)")
    return counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(won).alias("won")).select(
        F.coalesce("p", F.lit(0)).alias("positives"), F.coalesce("n", F.lit(0)).alias("negatives"),
        F.try_divide(F.col("won").cast("double"), 2.0 * F.col("p").cast("double") * F.col("n").cast("double")).alias("auc"))


def lift_by_decile(scored: DataFrame, score: str, label: str) -> DataFrame:
    """decile (1 has the highest scores), customers, positives, rate, and lift: the rate over that of all.

    A score's decile is where the first of its rows would stand, so rows of equal score are never parted and a decile
    may be missing or larger than a tenth.
    """
    counts = score_counts(scored, score, label)
    total = counts.agg(F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.sum("pos").alias("pos"))
    rows, positives = total.select("rows").scalar(), total.select("pos").scalar()
    before = F.col("pos_above") + F.col("neg_above")
    tenth = F.floor(10 * before / rows).cast("bigint") + 1
    by = counts.groupBy(tenth.alias("decile")).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("customers"), F.sum("pos").alias("positives"))
    rate = F.col("positives") / F.col("customers")
    return by.select(
        "decile", "customers", "positives", rate.alias("rate"),
        F.try_divide(rate, positives / rows).alias("lift")).orderBy("decile")


def _churn_scored(tables: Tables) -> DataFrame:
    """The score by spending beside what happened within the last 90 days."""
    happened = churn.churn_label_90d(tables).select("customer_id", "churn")
    return churn.fallback_risk(tables).select("customer_id", "churn_probability").join(happened, "customer_id")


def churn_auc(tables: Tables) -> DataFrame:
    return roc_auc(_churn_scored(tables), "churn_probability", "churn")


def churn_lift(tables: Tables) -> DataFrame:
    return lift_by_decile(_churn_scored(tables), "churn_probability", "churn")
