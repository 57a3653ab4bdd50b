"""Headline figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartlight.functions.money import average, money_sum
from cartlight.operators.common import CANCELLED, kept_orders, kept_status
from cartlight.tables import Tables


def total_revenue(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    total = money_sum(F.col("total_amount"))
    return kept_orders(tables, exclude_status).agg(F.coalesce(total, F.lit(0.0)).alias("revenue"))


def total_orders(tables: Tables) -> DataFrame:
    """All orders, cancelled ones included."""
    return tables.orders.agg(F.count(F.lit(1)).alias("total_orders"))


def total_customers(tables: Tables) -> DataFrame:
    return tables.customers.agg(F.count(F.lit(1)).alias("total_customers"))


def total_products(tables: Tables) -> DataFrame:
    return tables.products.agg(F.count(F.lit(1)).alias("total_products"))


def dashboard_kpis(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """The four cards in one row: one pass over orders, the two counts as scalar subqueries."""
    kept_amount = F.when(kept_status(exclude_status), F.col("total_amount"))
    return tables.orders.agg(
        F.coalesce(money_sum(kept_amount), F.lit(0.0)).alias("revenue"),
        F.count(F.lit(1)).alias("total_orders"),
    ).select(
        "revenue",
        "total_orders",
        total_customers(tables).scalar().alias("total_customers"),
        total_products(tables).scalar().alias("total_products"),
    )


def average_order_value(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Revenue per order, over all orders (``aov_literal``) and over the orders that earn it (``aov_net``)."""
    kept = kept_status(exclude_status)
    return tables.orders.agg(
        F.coalesce(money_sum(F.when(kept, F.col("total_amount"))), F.lit(0.0)).alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
        F.count(F.when(kept, F.lit(1))).alias("kept"),
    ).select(
        average(F.col("revenue"), F.col("orders")).alias("aov_literal"),
        average(F.col("revenue"), F.col("kept")).alias("aov_net"),
    )
