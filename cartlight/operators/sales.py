"""Sales reports by product, category, month, city and payment method; stock and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartlight.functions.money import average, money, money_sum
from cartlight.functions.parsing import month_label
from cartlight.functions.ranking import top_k
from cartlight.operators.common import CANCELLED, kept_orders, orders_by_customer, sales_by_product
from cartlight.tables import Tables


def top_products(tables: Tables, n: int = 10, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Products with the highest item revenue."""
    names = tables.products.select("product_id", "product_name")
    sold = sales_by_product(tables, exclude_status).join(names, "product_id").select(
        "product_id", "product_name", "units_sold", money(F.col("sold_micros")).alias("revenue")
    )
    return top_k(sold, n, F.desc("revenue"), F.asc("product_id"))


def category_revenue(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Item revenue per category, highest first. Categories without sales are absent.

    Reduced per product, then per category, before the category names are joined.
    """
    links = tables.products.select("product_id", "category_id")
    names = tables.categories.select("category_id", "category_name")
    return (
        sales_by_product(tables, exclude_status)
        .join(links, "product_id")
        .groupBy("category_id").agg(F.sum("sold_micros").alias("sold_micros"))
        .join(names, "category_id")
        .select("category_id", "category_name", money(F.col("sold_micros")).alias("revenue"))
        .orderBy(F.desc("revenue"), "category_id")
    )


def monthly_revenue(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Order revenue per calendar month, oldest first. Orders without a date form the NULL month."""
    return (
        kept_orders(tables, exclude_status)
        .groupBy(F.trunc("order_date", "month").alias("first_day"))
        .agg(money_sum(F.col("total_amount")).alias("revenue"))
        .select(month_label(F.col("first_day")).alias("month"), "revenue")
        .orderBy(F.asc_nulls_first("month"))
    )


def top_customers(tables: Tables, n: int = 10, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Customers with the highest order revenue."""
    names = tables.customers.select("customer_id", "customer_name")
    spending = orders_by_customer(tables, exclude_status).join(names, "customer_id").select(
        "customer_id", "customer_name", money(F.col("spent_micros")).alias("spending")
    )
    return top_k(spending, n, F.desc("spending"), F.asc("customer_id"))


def city_revenue(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Order revenue per customer city, highest first."""
    cities = tables.customers.select("customer_id", "city")
    return (
        orders_by_customer(tables, exclude_status)
        .join(cities, "customer_id")
        .groupBy("city")
        .agg(F.sum("total_orders").alias("total_orders"), money(F.sum("spent_micros")).alias("revenue"))
        .orderBy(F.desc("revenue"), "city")
    )


def payment_methods(tables: Tables) -> DataFrame:
    """Payments per method: number, amount, average, and the split by status."""
    paid = F.col("payment_status") == "Paid"
    return (
        tables.payments.groupBy("payment_method")
        .agg(
            F.count(F.lit(1)).alias("payments"),
            F.count("amount").alias("priced"),
            money_sum(F.col("amount")).alias("amount"),
            F.count(F.when(paid, F.lit(1))).alias("paid_payments"),
            F.coalesce(money_sum(F.when(paid, F.col("amount"))), F.lit(0.0)).alias("paid_amount"),
        )
        .select(
            "payment_method", "payments", "amount",
            average(F.col("amount"), F.col("priced")).alias("average_amount"),
            "paid_payments", "paid_amount",
            (F.col("payments") - F.col("paid_payments")).alias("open_payments"),
        )
        .orderBy(F.desc("amount"), "payment_method")
    )


def payments_by_status(tables: Tables) -> DataFrame:
    """Payments per method and status."""
    return (
        tables.payments.groupBy("payment_method", "payment_status")
        .agg(F.count(F.lit(1)).alias("payments"), money_sum(F.col("amount")).alias("amount"))
        .orderBy("payment_method", "payment_status")
    )


def low_stock(tables: Tables, threshold: int = 30) -> DataFrame:
    """Products with at most ``threshold`` pieces left, scarcest first."""
    return (
        tables.products.filter(F.col("stock_quantity") <= threshold)
        .select("product_id", "product_name", "stock_quantity")
        .orderBy("stock_quantity", "product_id")
    )


def review_scores(tables: Tables) -> DataFrame:
    return (
        tables.reviews.groupBy("product_id")
        .agg(F.sum("rating").alias("points"), F.count("rating").alias("reviews"))
        .select("product_id", average(F.col("points"), F.col("reviews")).alias("review_rating"), "reviews")
    )


def product_ratings(tables: Tables) -> DataFrame:
    """Catalogue rating next to the average review of every product, best reviewed first."""
    return (
        tables.products.select("product_id", "product_name", F.col("rating").alias("catalog_rating"))
        .join(review_scores(tables), "product_id", "left")
        .withColumn("reviews", F.coalesce("reviews", F.lit(0)))
        .orderBy(F.desc("review_rating"), F.desc("reviews"), "product_id")
    )


def product_performance(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """Quantity, revenue, rating, category and stock of every product; zeros where nothing was sold."""
    names = tables.categories.select("category_id", "category_name")
    return (
        tables.products
        .join(sales_by_product(tables, exclude_status), "product_id", "left")
        .join(names, "category_id", "left")
        .select(
            "product_id", "product_name", "category_name", "stock_quantity", "rating",
            F.coalesce("units_sold", F.lit(0)).alias("units_sold"),
            F.coalesce(money(F.col("sold_micros")), F.lit(0.0)).alias("revenue"),
        )
        .orderBy(F.desc("revenue"), "product_id")
    )


