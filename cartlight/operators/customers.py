"""Customer purchase profiles and spending statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartlight.functions.money import MICROS, average, micros_key, money
from cartlight.functions.ranking import exact_quantiles, top_k
from cartlight.operators.common import CANCELLED, orders_by_customer
from cartlight.session import materialize
from cartlight.tables import Tables


def _profiles(tables: Tables, exclude_status: str | None) -> DataFrame:
    people = tables.customers.select("customer_id", "customer_name", "city")
    return orders_by_customer(tables, exclude_status).join(people, "customer_id")


def customer_profile(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Orders, spending and average order value of every customer who ordered, biggest spender first."""
    return _shaped(_profiles(tables, exclude_status)).orderBy(F.desc("total_spending"), "customer_id")


def _shaped(profiles: DataFrame) -> DataFrame:
    spending = money(F.col("spent_micros"))
    return profiles.select(
        "customer_id", "customer_name", "city", "total_orders",
        spending.alias("total_spending"),
        average(spending, F.col("priced_orders")).alias("average_order_value"),
    )


def best_customer(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    return top_k(_shaped(_profiles(tables, exclude_status)), 1, F.desc("total_spending"), F.asc("customer_id"))


def spending_stats(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of spending per customer.

    The spending per customer is written once to the checkpoint folder; everything else reads that.
    """
    spent = materialize(_profiles(tables, exclude_status).select("spent_micros").filter("spent_micros is not null"))
    cuts = exact_quantiles(spent, {"spent": micros_key(F.col("spent_micros"))}, [0.25, 0.5, 0.75], scale=MICROS)["spent"]
    value = money(F.col("spent_micros"))
    return spent.agg(
        F.count(F.lit(1)).alias("count"),
        average(money(F.sum("spent_micros")), F.count(F.lit(1))).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        *[F.lit(cut).cast("double").alias(name) for name, cut in zip(("q25", "q50", "q75"), cuts)],
        F.max(value).alias("max"),
    )


def repeat_customers(
    tables: Tables, min_orders: int = 2, exclude_status: str | None = CANCELLED
) -> DataFrame:
    """Customers with at least ``min_orders`` orders, most orders first."""
    return (
        _shaped(_profiles(tables, exclude_status))
        .filter(F.col("total_orders") >= min_orders)
        .select("customer_id", "customer_name", "total_orders", "total_spending")
        .orderBy(F.desc("total_orders"), "customer_id")
    )


def repeat_rate(tables: Tables, min_orders: int = 2, exclude_status: str | None = CANCELLED) -> DataFrame:
    """How many of the ordering customers came back. Like the profiles, known customers only."""
    again = F.count(F.when(F.col("total_orders") >= min_orders, F.lit(1)))
    buyers = orders_by_customer(tables, exclude_status)
    return buyers.join(tables.customers.select("customer_id"), "customer_id", "left_semi").agg(
        F.count(F.lit(1)).alias("buyers"), again.alias("repeat_buyers")
    ).withColumn("repeat_rate", average(F.col("repeat_buyers"), F.col("buyers")))


def high_value_customers(
    tables: Tables, quantile: float = 0.9, exclude_status: str | None = CANCELLED
) -> DataFrame:
    """Customers whose spending reaches the given quantile, with their share of the spending of all."""
    profiles = materialize(_profiles(tables, exclude_status).filter("spent_micros is not null"))
    cut = exact_quantiles(profiles, {"spent": micros_key(F.col("spent_micros"))}, [quantile], scale=MICROS)["spent"][0]
    everything = profiles.agg(money(F.sum("spent_micros"))).scalar()
    return (
        _shaped(profiles)
        .filter(F.col("total_spending") >= F.lit(cut))
        .select(
            "customer_id", "customer_name", "total_spending",
            F.try_divide("total_spending", everything).alias("revenue_share"),
        )
        .orderBy(F.desc("total_spending"), "customer_id")
    )
