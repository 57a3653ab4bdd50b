"""Steps that several jobs share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartlight.functions.money import micros_sum
from cartlight.tables import Tables

CANCELLED = "Cancelled"


def kept_status(exclude_status: str | None) -> Column:
    """True for orders that count. A NULL status never counts once a status is excluded."""
    if exclude_status is None:
        return F.lit(True)
    return F.col("order_status") != exclude_status


def kept_orders(tables: Tables, exclude_status: str | None) -> DataFrame:
    return tables.orders.filter(kept_status(exclude_status))


def orders_by_customer(tables: Tables, exclude_status: str | None) -> DataFrame:
    """One row per ordering customer: total_orders, priced_orders (amount known), spent_micros.

    Reduced before any join, so a customer with a third of all orders reaches the join as one row.
    """
    return kept_orders(tables, exclude_status).groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        F.count("total_amount").alias("priced_orders"),
        micros_sum(F.col("total_amount")).alias("spent_micros"),
    )


def sales_by_product(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """One row per sold product: units_sold, sold_micros.

    The one join of the two big tables. Only order_id crosses from the orders side; adaptive
    execution splits an order_id that holds a large share of the items.
    """
    kept = kept_orders(tables, exclude_status).select("order_id")
    items = tables.order_items.select("order_id", "product_id", "quantity", "unit_price")
    return (
        items.join(kept, "order_id")
        .groupBy("product_id")
        .agg(
            F.sum("quantity").alias("units_sold"),
            micros_sum(F.col("quantity") * F.col("unit_price")).alias("sold_micros"),
        )
    )
