"""The physical plans have the shape that holds on large tables."""

import re

import pytest

from cartlight.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name, final=False):
    df = registry.queries()[name](spark, FOLDER)
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_products_of_tables_and_no_python(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", ["top_products", "top_customers", "best_customer", "top_spender", "reco_popular"])
def test_top_k_does_not_sort_everything(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["reco_all_customers", "reco_unseen", "reco_history_pairs", "upsert_latest"])
def test_top_k_per_key_is_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_scans_read_only_what_is_needed(spark):
    text = plan(spark, "top_products")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any(s.startswith("l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double") for s in schemas)
    assert not any("l_comment" in s or "l_tax" in s for s in schemas)
    assert "o_orderkey:bigint,o_orderstatus:string" in schemas


def test_filters_reach_the_scan(spark, seed, tmp_path):
    from cartlight.operators import kpi, recommend, sales
    from cartlight.sources import store

    for name in seed.names():
        store.append(getattr(seed, name), str(tmp_path), name)
    stored = store.read_store(spark, str(tmp_path))

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Not(EqualTo(order_status,Cancelled))" in text(kpi.total_revenue(stored))
    assert "Not(EqualTo(order_status,Cancelled))" in text(sales.top_products(stored))
    assert "LessThanOrEqual(stock_quantity,30)" in text(sales.low_stock(stored))
    assert "EqualTo(customer_id,1)" in text(recommend.history_pairs(stored, customer_id=1))
    assert "ReadSchema: struct<order_id:bigint,order_status:string>" in text(sales.top_products(stored))


def test_one_pass_over_orders_for_the_dashboard(spark):
    text = plan(spark, "dashboard_kpis")
    assert len(re.findall(r"ReadSchema: struct<[^>]*o_totalprice", text)) == 1


def test_customer_is_a_plain_scan_where_the_city_is_not_used(spark):
    text = plan(spark, "customer_lookup")
    assert "nation" not in text


def test_hot_order_is_split(spark):
    """An order with a third of all items: the join is split by adaptive execution, the total stays right."""
    from pyspark.sql import functions as F

    from cartlight.operators.common import sales_by_product
    from cartlight.tables import Tables

    items = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("order_id"),
        (F.col("id") % 50).alias("product_id"), F.lit(1).alias("quantity"), F.lit(1.0).alias("unit_price"))
    orders = spark.range(60000).select(F.col("id").alias("order_id"), F.lit("Delivered").alias("order_status"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = sales_by_product(Tables({"orders": orders, "order_items": items}))
        total = sum(r["units_sold"] for r in df.collect())
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        assert total == 60000
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_results_do_not_depend_on_partitions(spark):
    names = ["category_revenue", "customer_profile", "reco_all_customers", "churn_labels"]

    def run():
        return {n: sorted(map(str, registry.queries()[n](spark, FOLDER).collect())) for n in names}

    before = run()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert run() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
