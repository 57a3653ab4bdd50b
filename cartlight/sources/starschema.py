"""The shop tables as views over the TPC-H-like test tables.

Explicit schemas save the footer-reading job of every scan; column pruning and filters reach the
Parquet readers because the views are plain projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartlight.session import prepare
from cartlight.tables import Tables

_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def event_schema() -> str:
    return _SCHEMAS["events"]


def shop_tables(spark: SparkSession, folder: str) -> Tables:
    """All eight shop tables over the star schema in ``folder``."""
    prepare(spark)

    def source(name: str) -> DataFrame:
        return scan(spark, folder, name)

    # A key made from the type name alone: 60 bits of its hash. Products need no join to get it.
    category_id = F.conv(F.substring(F.md5(F.col("p_type").cast("binary")), 1, 15), 16, 10).cast("bigint")

    def lookup(dimension: DataFrame, key: str, value: str) -> Column:
        """A fixed, tiny dimension (25 nations, 5 regions) as a map; nothing is read where it is not used."""
        return dimension.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()

    def customers() -> DataFrame:
        nation, region = source("nation"), source("region")
        states = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return source("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.concat(F.lit("c"), "c_custkey", F.lit("@example.com")).alias("email"),
            F.lit(None).cast("string").alias("phone"),
            F.element_at(lookup(nation, "n_nationkey", "n_name"), F.col("c_nationkey")).alias("city"),
            F.element_at(lookup(states, "n_nationkey", "r_name"), F.col("c_nationkey")).alias("state"),
            F.lit("India").alias("country"),
            F.lit(None).cast("date").alias("registration_date"),
            F.lit(None).cast("string").alias("gender"),
            F.lit(None).cast("int").alias("age"),
        )

    def categories() -> DataFrame:
        return (
            source("part").filter("p_type is not null").select("p_type").distinct()
            .select(
                category_id.alias("category_id"),
                F.col("p_type").alias("category_name"),
                F.lit(None).cast("string").alias("description"),
            )
        )

    def products() -> DataFrame:
        return source("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            category_id.alias("category_id"),
            F.col("p_retailprice").alias("price"),
            F.col("p_size").alias("stock_quantity"),
            F.col("p_brand").alias("brand"),
            (F.lit(1.0) + (F.col("p_partkey") % 41) / F.lit(10.0)).alias("rating"),
        )

    def orders() -> DataFrame:
        status = F.col("o_orderstatus")
        return source("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.when(status == "F", "Delivered").when(status == "O", "Shipped")
            .when(status == "P", "Cancelled").alias("order_status"),
            F.col("o_totalprice").alias("total_amount"),
        )

    def order_items() -> DataFrame:
        return source("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").alias("unit_price"),
        )

    def payments() -> DataFrame:
        return source("orders").select(
            F.col("o_orderkey").alias("payment_id"),
            F.col("o_orderkey").alias("order_id"),
            F.to_date("o_orderdate").alias("payment_date"),
            F.col("o_orderpriority").alias("payment_method"),
            F.when(F.col("o_orderstatus") == "P", "Pending").otherwise("Paid").alias("payment_status"),
            F.col("o_totalprice").alias("amount"),
        )

    def shipping() -> DataFrame:
        return (
            source("lineitem").groupBy("l_orderkey")
            .agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
            .select(
                F.col("l_orderkey").alias("shipping_id"),
                F.col("l_orderkey").alias("order_id"),
                F.to_date("first").alias("shipping_date"),
                F.to_date("last").alias("delivery_date"),
                F.lit("Delivered").alias("shipping_status"),
                F.lit(None).cast("string").alias("shipping_city"),
            )
        )

    def reviews() -> DataFrame:
        customers_of = source("orders").select("o_orderkey", "o_custkey")
        return (
            source("lineitem").join(customers_of, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("o_custkey").alias("customer_id"),
                F.col("l_partkey").alias("product_id"),
                (F.lit(1) + (F.col("l_linenumber") - 1) % 5).alias("rating"),
            )
        )

    return Tables({
        "customers": customers, "categories": categories, "products": products, "orders": orders,
        "order_items": order_items, "payments": payments, "shipping": shipping, "reviews": reviews,
    })
