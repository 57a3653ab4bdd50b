"""List views and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartlight.functions.money import money_sum
from cartlight.tables import Tables


def customers_list(tables: Tables) -> DataFrame:
    """All customers, newest id first."""
    return tables.customers.orderBy(F.desc("customer_id"))


def products_list(tables: Tables) -> DataFrame:
    """All products with their category name (NULL for an unknown category), newest id first."""
    names = tables.categories.select("category_id", "category_name")
    return tables.products.join(names, "category_id", "left").select(
        "product_id", "product_name", "category_id", "price", "stock_quantity", "brand", "rating", "category_name"
    ).orderBy(F.desc("product_id"))


def orders_list(tables: Tables) -> DataFrame:
    """Orders of known customers, latest first."""
    names = tables.customers.select("customer_id", "customer_name")
    return (
        tables.orders.join(names, "customer_id")
        .select("order_id", "customer_name", "order_date", "order_status", "total_amount")
        .orderBy(F.desc("order_date"), F.desc("order_id"))
    )


def category_lookup(tables: Tables) -> DataFrame:
    return tables.categories.select("category_id", "category_name").orderBy("category_name", "category_id")


def customer_lookup(tables: Tables) -> DataFrame:
    return tables.customers.select("customer_id", "customer_name").orderBy("customer_name", "customer_id")


def product_lookup(tables: Tables) -> DataFrame:
    return tables.products.select("product_id", "product_name", "price").orderBy("product_name", "product_id")


def order_lines(tables: Tables) -> DataFrame:
    """Every order item with its product name (NULL for an unknown product) and amount."""
    names = tables.products.select("product_id", "product_name")
    return tables.order_items.join(names, "product_id", "left").select(
        "order_id", "product_id", "product_name", "quantity", "unit_price",
        (F.col("quantity") * F.col("unit_price")).alias("line_amount"),
    )


def order_payments(tables: Tables) -> DataFrame:
    """Every payment beside its order (NULL columns for a payment without one)."""
    orders = tables.orders.select("order_id", "customer_id", "order_status", "total_amount")
    return tables.payments.join(orders, "order_id", "left").select(
        "payment_id", "order_id", "customer_id", "order_status", "payment_date", "payment_method", "payment_status",
        "amount", "total_amount",
    )


def order_shipments(tables: Tables) -> DataFrame:
    """Every shipment beside its order, with the days from order to delivery."""
    orders = tables.orders.select("order_id", "customer_id", "order_status", "order_date")
    return tables.shipping.join(orders, "order_id", "left").select(
        "shipping_id", "order_id", "customer_id", "order_status", "shipping_date", "delivery_date", "shipping_status",
        F.datediff("delivery_date", "order_date").cast("bigint").alias("days_to_delivery"),
    )


def order_detail(tables: Tables, paid_status: str = "Paid") -> DataFrame:
    """One row per order with its items, payments and shipments, none of them left out.

    Paid amounts and those of any other status are apart; ``order_payments`` and ``order_shipments`` show the rows
    themselves. Each side is reduced to one row per order_id by sums, counts and dates, which need no sort, so
    nothing fans out and all joins share the order_id partitioning.
    """
    items = tables.order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_lines"),
        F.sum("quantity").alias("units"),
        money_sum(F.col("quantity") * F.col("unit_price")).alias("items_amount"),
    )
    paid = F.coalesce(F.col("payment_status") == paid_status, F.lit(False))
    payments = tables.payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payments"),
        money_sum(F.when(paid, F.col("amount"))).alias("paid_amount"),
        money_sum(F.when(~paid, F.col("amount"))).alias("open_amount"),
        F.max("payment_date").alias("last_payment_date"),
    )
    shipments = tables.shipping.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("shipments"),
        F.min("shipping_date").alias("first_shipping_date"),
        F.max("delivery_date").alias("last_delivery_date"),
        F.count(F.when(F.col("delivery_date").isNull(), F.lit(1))).alias("undelivered"),
    )
    return (
        tables.orders
        .join(items, "order_id", "left")
        .join(payments, "order_id", "left")
        .join(shipments, "order_id", "left")
        .select(
            "order_id", "customer_id", "order_date", "order_status", "total_amount",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("item_lines", "units")],
            F.coalesce("items_amount", F.lit(0.0)).alias("items_amount"),
            F.coalesce("payments", F.lit(0)).alias("payments"),
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("paid_amount", "open_amount")], "last_payment_date",
            F.coalesce("shipments", F.lit(0)).alias("shipments"), "first_shipping_date", "last_delivery_date",
            F.coalesce("undelivered", F.lit(0)).alias("undelivered"),
        )
    )
