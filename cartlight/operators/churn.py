"""Churn: features, labels, split, random forest, risk ranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cartlight.functions.money import MICROS, average, micros, micros_sum, money
from cartlight.functions.ranking import exact_quantiles, extents, top_k, values_at_ranks
from cartlight.operators.common import kept_orders, orders_by_customer
from cartlight.session import materialize
from cartlight.tables import Tables

FEATURES = ["total_orders", "total_spending", "average_order_value"]

# Fixed values of the model: trees, seed, share of the test part.
TREES = 100
SEED = 42
TEST_SHARE = 0.2


def churn_features(tables: Tables, exclude_status: str | None = None) -> DataFrame:
    """Orders, spending and average order value of every customer; zeros for customers without orders."""
    spending = money(F.col("spent_micros"))
    return (
        tables.customers.select("customer_id", "customer_name")
        .join(orders_by_customer(tables, exclude_status), "customer_id", "left")
        .select(
            "customer_id", "customer_name",
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            F.coalesce(spending, F.lit(0.0)).alias("total_spending"),
            F.coalesce(average(spending, F.col("priced_orders")), F.lit(0.0)).alias("average_order_value"),
        )
    )


def label_by_median(features: DataFrame) -> DataFrame:
    """Add ``churn`` = 1 where spending is at or below the exact median. Pass a materialized frame."""
    spent = {"spent": micros(F.col("total_spending"))}
    median = exact_quantiles(features, spent, [0.5], scale=MICROS)["spent"][0]
    return features.withColumn("churn", F.when(F.col("total_spending") <= F.lit(median), 1).otherwise(0))


def churn_labels(tables: Tables, exclude_status: str | None = None) -> DataFrame:
    """Features with their label.

    The features are written once to the checkpoint folder: the median and the labels read them.
    """
    return label_by_median(materialize(churn_features(tables, exclude_status)))


def _test_sizes(sizes: dict[int, int], test_share: float) -> dict[int, int]:
    """Test rows per label: training rows are dealt in proportion, left-over ones to the largest fractions."""
    total = sum(sizes.values())
    if total == 0:
        return {}
    train = total - math.ceil(test_share * total)
    exact = {label: n * train / total for label, n in sizes.items()}
    whole = {label: math.floor(x) for label, x in exact.items()}
    spare = train - sum(whole.values())
    by_rest = sorted(sizes, key=lambda label: (whole[label] - exact[label], label))
    return {label: n - whole[label] - (label in by_rest[:spare]) for label, n in sizes.items()}


def stratified_split(
    labelled: DataFrame, label: str = "churn", key: str = "customer_id",
    test_share: float = TEST_SHARE, seed: int = SEED,
) -> DataFrame:
    """Add ``is_test``: an exact ``test_share`` of the rows, with every label represented in proportion.

    Rows are taken by the smallest hash of (key, seed); the hash is one-to-one on a bigint key. The
    cut-off per label is found by counting, not by sorting a label's rows in one task. ``labelled`` is
    read once per counting pass, so pass a materialized frame.
    """
    hashed = labelled.withColumn("_hash", F.xxhash64(F.col(key).cast("bigint"), F.lit(seed).cast("bigint")))
    rows = hashed.select(F.col(label).alias("grp"), F.col("_hash").alias("v"))
    extent = extents(rows)
    tests = _test_sizes({g: n for g, (n, _, _) in extent.items()}, test_share)
    cuts = values_at_ranks(rows, extent, {g: [n - 1] for g, n in tests.items() if n > 0})
    is_test = F.lit(False)
    for (g, _), cut in cuts.items():
        is_test = is_test | ((F.col(label) == g) & (F.col("_hash") <= cut))
    return hashed.withColumn("is_test", is_test).drop("_hash")


def churn_split_counts(tables: Tables) -> DataFrame:
    return (
        stratified_split(churn_labels(tables))
        .groupBy("churn", "is_test").agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("churn", "is_test")
    )


@dataclass
class ChurnModel:
    """A fitted pipeline and the labels it has seen: 0, 1 or both."""

    pipeline: PipelineModel
    labels: list[int]

    @property
    def one_class(self) -> bool:
        return len(self.labels) < 2


def _classifier(kind: str):
    if kind == "forest":
        return RandomForestClassifier(labelCol="churn", featuresCol="features", numTrees=TREES, seed=SEED)
    if kind == "boosted":
        return GBTClassifier(labelCol="churn", featuresCol="features", seed=SEED)
    raise ValueError(f"unknown classifier {kind}")


def fit_churn(labelled: DataFrame, kind: str = "forest") -> ChurnModel:
    """Fit on rows with the three features and ``churn``, 0 or 1. Raises ValueError on an empty table or other labels.

    Pass a materialized frame: training reads it several times.
    """
    seen = labelled.agg(*[F.coalesce(F.bool_or(F.col("churn") == k), F.lit(False)) for k in (0, 1)], F.coalesce(
        F.bool_or(F.coalesce(~F.col("churn").isin(0, 1), F.lit(True))), F.lit(False))).first()
    if seen[2]:
        raise ValueError("churn must be 0 or 1")
    labels = [k for k in (0, 1) if seen[k]]
    if not labels:
        raise ValueError("no customers to train on")
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="features"), _classifier(kind)]
    return ChurnModel(Pipeline(stages=stages).fit(labelled), labels)


def train_on(features: DataFrame, kind: str = "forest") -> tuple[ChurnModel, DataFrame]:
    """Label and split materialized features, fit on the training part; the model and one row of test metrics."""
    split = stratified_split(label_by_median(features))
    model = fit_churn(split.filter(~F.col("is_test")), kind)
    tested = model.pipeline.transform(split.filter("is_test"))
    hit = F.when(F.col("prediction") == F.col("churn"), 1.0).otherwise(0.0)
    train_rows = split.filter(~F.col("is_test")).agg(F.count(F.lit(1))).scalar()
    metrics = tested.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("test_rows")).withColumn(
        "train_rows", train_rows
    )
    return model, metrics


def train_and_test(tables: Tables, kind: str = "forest") -> tuple[ChurnModel, DataFrame]:
    return train_on(materialize(churn_features(tables)), kind)


def churn_scores(tables: Tables, kind: str = "forest") -> DataFrame:
    """Train, then score every customer; the orders are read once for both."""
    features = materialize(churn_features(tables))
    model, _ = train_on(features, kind)
    return score_churn(model, features)


def _with_fallback(features: DataFrame) -> DataFrame:
    """1 - spending / highest spending, held within 0..1; 1 where nobody has spent anything.

    The features are read twice, so they are written once to the checkpoint folder.
    """
    features = materialize(features)
    highest = features.agg(F.max("total_spending")).scalar()
    ratio = F.lit(1.0) - F.try_divide("total_spending", highest)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(1.0))))
    return features.withColumn("churn_probability", score)


def score_churn(model: ChurnModel, features: DataFrame) -> DataFrame:
    """Add ``churn_probability`` to every customer in one pass."""
    if model.one_class:
        return _with_fallback(features)
    scored = model.pipeline.transform(features)
    probability = vector_to_array("probability")[1]
    return scored.select(*features.columns, probability.alias("churn_probability"))


def fallback_risk(tables: Tables) -> DataFrame:
    """Every customer's score when the model knows one class only."""
    return _with_fallback(churn_features(tables))


def top_risk(scored: DataFrame, n: int = 5) -> DataFrame:
    """The customers most at risk, as a 0-100 score with one decimal; ties by higher spending."""
    risk = F.round(F.col("churn_probability") * 100, 1).alias("risk_score")
    return top_k(
        scored.select("customer_id", "customer_name", *FEATURES, risk),
        n, F.desc("risk_score"), F.desc("total_spending"), F.asc("customer_id"),
    )


def churn_label_90d(
    tables: Tables, cutoff: str | None = None, days: int = 90, exclude_status: str | None = None
) -> DataFrame:
    """Known customers who bought before ``cutoff``; churn = 1 where no purchase follows within ``days``.

    The window runs from the cutoff day to ``days`` days later, both included; without a cutoff it ends
    with the last order date. One grouped pass over the orders.
    """
    return _labels_90d(tables, cutoff, days, exclude_status).drop("cutoff").orderBy("customer_id")


def _labels_90d(tables: Tables, cutoff: str | None, days: int, exclude_status: str | None) -> DataFrame:
    orders = kept_orders(tables, exclude_status)
    if cutoff is None:
        start = orders.agg(F.date_sub(F.max("order_date"), days)).scalar()
    else:
        start = F.lit(cutoff).cast("date")
    day = F.col("order_date")
    dated = orders.select("customer_id", "order_date").withColumn("cutoff", start)
    cut = F.col("cutoff")
    return (
        dated.filter(day <= F.date_add(cut, days))
        .join(tables.customers.select("customer_id"), "customer_id", "left_semi")
        .groupBy("customer_id", "cutoff")
        .agg(
            F.count(F.when(day < cut, F.lit(1))).alias("orders_before"),
            F.count(F.when(day >= cut, F.lit(1))).alias("orders_in_window"),
        )
        .filter("orders_before > 0")
        .withColumn("churn", F.when(F.col("orders_in_window") == 0, 1).otherwise(0))
    )


def churn_90d_features(
    tables: Tables, cutoff: str | None = None, days: int = 90, exclude_status: str | None = None
) -> DataFrame:
    """The three features of each customer from orders before the cutoff alone, with the label of ``churn_label_90d``.

    So the label is no function of a feature, and a model of it can be used on the day of the cutoff.
    """
    labels = _labels_90d(tables, cutoff, days, exclude_status).select("customer_id", "cutoff", "churn")
    orders = kept_orders(tables, exclude_status).select("customer_id", "order_date", "total_amount")
    before = orders.join(labels, "customer_id").filter(F.col("order_date") < F.col("cutoff"))
    measured = before.groupBy("customer_id", "churn").agg(
        F.count(F.lit(1)).alias("total_orders"), F.count("total_amount").alias("priced"),
        micros_sum(F.col("total_amount")).alias("spent"),
    )
    spending = F.coalesce(money(F.col("spent")), F.lit(0.0))
    return measured.select(
        "customer_id", "total_orders", spending.alias("total_spending"),
        F.coalesce(average(spending, F.col("priced")), F.lit(0.0)).alias("average_order_value"), "churn",
    ).orderBy("customer_id")


def churn_90d_metrics(tables: Tables, kind: str = "forest") -> DataFrame:
    """Train on later inactivity; one row of test figures beside the share of the commoner label."""
    labelled = materialize(churn_90d_features(tables))
    split = materialize(stratified_split(labelled))
    model = fit_churn(split.filter(~F.col("is_test")), kind)
    tested = model.pipeline.transform(split.filter("is_test"))
    hit = F.when(F.col("prediction") == F.col("churn"), 1.0).otherwise(0.0)
    counts = split.agg(
        F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"),
        F.avg("churn").alias("churn_share"),
    )
    return counts.withColumn("accuracy", tested.agg(F.avg(hit)).scalar())
