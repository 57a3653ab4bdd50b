"""Headline and monthly figures kept up to date from newly stored batches alone.

What is kept is mergeable: counts, exact sums and sketches per day and status, a few rows however large the orders.
A refresh reads the batches that its ledger does not list yet, adds their partials to the kept ones and writes both, with the
new ledger, as the next version, whose marker is written last. One writer at a time; readers see whole versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartlight import schemas
from cartlight.functions.money import micros_sum, money
from cartlight.functions.parsing import month_label
from cartlight.operators.common import CANCELLED, kept_status
from cartlight.sources import store

TABLES = ("orders", "customers", "products")
# The name under which the ledger holds a table's first folder, which is no batch.
FIRST = "(first)"
_KEY = ["kind", "day", "order_status"]
_SUMS = {"n": "bigint", "priced": "bigint", "micros": "decimal(38,0)"}


def partials(frame: DataFrame, kind: str) -> DataFrame:
    """What is kept of new rows of a table: per day and status for orders, one row for the others."""
    nothing = F.lit(None)
    if kind != "orders":
        return frame.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), nothing.cast("date").alias("day"), nothing.cast("string").alias("order_status"), "n",
            F.lit(0).cast("bigint").alias("priced"), nothing.cast("decimal(38,0)").alias("micros"),
            nothing.cast("binary").alias("buyers"), nothing.cast("binary").alias("amounts"),
        )
    amount = F.when(~F.isnan("total_amount"), F.col("total_amount"))
    return frame.groupBy(F.col("order_date").alias("day"), "order_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("total_amount").alias("priced"),
        micros_sum(F.col("total_amount")).cast("decimal(38,0)").alias("micros"),
        F.hll_sketch_agg("customer_id").alias("buyers"),
        F.when(F.count(amount) > 0, F.kll_sketch_agg_double(amount)).alias("amounts"),
    ).select(F.lit(kind).alias("kind"), "day", "order_status", *_SUMS, "buyers", "amounts")


def _all_amounts() -> Column:
    """Aggregate: the sketches as one, NULL where no amount was seen."""
    return F.when(F.count("amounts") > 0, F.kll_merge_agg_double("amounts"))


def merged(parts: DataFrame) -> DataFrame:
    """Partials of several batches as one, in any order and grouping with the same sums and counts."""
    return parts.groupBy(*_KEY).agg(
        *[F.sum(c).cast(t).alias(c) for c, t in _SUMS.items()],
        F.hll_union_agg("buyers").alias("buyers"), _all_amounts().alias("amounts"),
    )


def _new_rows(spark: SparkSession, folder: str, held: set[str]) -> tuple[dict[str, list[str]], list[str]]:
    """The folders per table that the ledger does not have, and the names to be listed."""
    paths: dict[str, list[str]] = {name: [] for name in TABLES}
    names = []
    for batch in store.whole_batches(spark, folder):
        name = batch.rsplit("/", 1)[1]
        if name not in held:
            names.append(name)
            for table in TABLES:
                if store.has_folder(spark, f"{batch}/{table}"):
                    paths[table].append(f"{batch}/{table}")
    for table in TABLES:
        if f"{FIRST}{table}" not in held and store.has_folder(spark, f"{folder}/{table}"):
            names.append(f"{FIRST}{table}")
            paths[table].append(f"{folder}/{table}")
    return paths, names


def newest(spark: SparkSession, home: str) -> str | None:
    versions = store.whole_folders(spark, home)
    return versions[-1] if versions else None


def new_partials(spark: SparkSession, folder: str, held: set[str]) -> tuple[DataFrame | None, list[str]]:
    """Partials of what the ledger does not list; nothing else is scanned. Also the names to be listed."""
    paths, names = _new_rows(spark, folder, held)
    made = None
    for table, places in paths.items():
        if places:
            part = partials(spark.read.schema(schemas.schema(table)).parquet(*places), table)
            made = part if made is None else made.unionByName(part)
    return made, names


def refresh(spark: SparkSession, folder: str, home: str) -> list[str]:
    """Bring the partials in ``home`` up to the batches in the store ``folder``; says which were new.

    A refresh that fails leaves the version before it. Batches are never changed once they are whole; a table that was
    replaced by a snapshot (``store.write_snapshot``) needs a new ``home``.
    """
    last = newest(spark, home)
    held = {r["batch"] for r in spark.read.schema("batch string").parquet(f"{last}/batches").collect()} if last else set()
    made, names = new_partials(spark, folder, held)
    if not names:
        return []
    number = int(last.rsplit("/", 1)[1]) + 1 if last else 0
    version = f"{home}/{number:09d}"
    if last:
        before = spark.read.parquet(f"{last}/rows")
        made = before if made is None else before.unionByName(made)
    if made is not None:
        merged(made).coalesce(1).write.mode("overwrite").parquet(f"{version}/rows")
    ledger = spark.createDataFrame([(b,) for b in sorted(held | set(names))], "batch string")
    ledger.coalesce(1).write.mode("overwrite").parquet(f"{version}/batches")
    store.mark_whole(spark, version)
    return names


def read_partials(spark: SparkSession, home: str) -> DataFrame:
    version = newest(spark, home)
    if version is None or not store.has_folder(spark, f"{version}/rows"):
        raise ValueError(f"no figures in {home}: refresh them first")
    return spark.read.parquet(f"{version}/rows")


def _of(kind: str):
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))


def dashboard(parts: DataFrame, exclude_status: str | None = CANCELLED) -> DataFrame:
    """The four headline figures, as ``kpi.dashboard_kpis`` has them from all rows."""
    kept = F.when((F.col("kind") == "orders") & kept_status(exclude_status), F.col("micros"))
    return parts.agg(
        F.coalesce(money(F.sum(kept)), F.lit(0.0)).alias("revenue"),
        *[_of(kind).alias(f"total_{kind}") for kind in TABLES],
    )


def monthly(parts: DataFrame, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Order revenue per month, as ``sales.monthly_revenue`` has it from all rows."""
    kept = parts.filter((F.col("kind") == "orders") & kept_status(exclude_status))
    return kept.groupBy(F.trunc("day", "month").alias("first")).agg(money(F.sum("micros")).alias("revenue")).select(
        month_label(F.col("first")).alias("month"), "revenue").orderBy(F.asc_nulls_first("month"))


def buyers_and_amounts(parts: DataFrame, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Per month: orders, about how many buyers (within some per cent) and about the median order amount."""
    kept = parts.filter((F.col("kind") == "orders") & kept_status(exclude_status))
    return kept.groupBy(F.trunc("day", "month").alias("first")).agg(
        F.sum("n").alias("orders"), F.hll_sketch_estimate(F.hll_union_agg("buyers")).alias("buyers"),
        F.kll_sketch_get_quantile_double(_all_amounts(), F.lit(0.5)).alias("median_amount"),
    ).select(month_label(F.col("first")).alias("month"), "orders", "buyers", "median_amount").orderBy(F.asc_nulls_first("month"))
