"""The store by month: what is read, and that nothing is lost."""

from __future__ import annotations

import pytest

from cartlight.operators import churn, forecast, sales
from cartlight.sources import jdbc, store
from tests.seed import order, seed_tables


def _store(spark, folder):
    """Orders of ten months, one without a date, items of each, an item without an order; half of them a batch."""
    tables = seed_tables(spark)
    rows = [order(k, k % 7, f"2025-{k % 10 + 1:02d}-{k % 28 + 1:02d}", total=float(k)) for k in range(200)] + [order(900, 1, None)]
    orders = spark.createDataFrame(rows, tables.orders.schema)
    items = [(k, k % 200, k % 14 + 1, 2, 3.0) for k in range(600)] + [(900, 900, 1, 1, 1.0), (901, 777, 1, 1, 1.0)]
    items = spark.createDataFrame(items, tables.order_items.schema)
    first, later = "order_id % 2 = 0", "order_id % 2 = 1"
    store.append_batch({"orders": orders.filter(first), "order_items": items.filter(first)}, folder, "a")
    store.write_by_month(spark, folder, "1")
    store.append_batch({"orders": orders.filter(later), "order_items": items.filter(later)}, folder, "b")
    store.append_batch({"products": tables.products, "categories": tables.categories, "customers": tables.customers}, folder, "c")
    return tables.replace(orders=orders, order_items=items)


def ordered(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_all_rows_and_chosen_months(spark, tmp_path):
    folder = str(tmp_path)
    tables = _store(spark, folder)
    for compacted in (False, True):
        if compacted:
            store.write_by_month(spark, folder, "2")
        read = store.read_store(spark, folder)
        assert read.orders.columns == tables.orders.columns and ordered(read.orders) == ordered(tables.orders)
        assert ordered(read.order_items) == ordered(tables.order_items)
        some = store.read_months(spark, folder, "2025-03", "2025-05")
        within = tables.orders.filter("order_date between '2025-03-01' and '2025-05-31'")
        assert ordered(some.orders) == ordered(within)
        assert ordered(sales.category_revenue(some)) == ordered(sales.category_revenue(tables.replace(orders=within)))
        recent = store.read_months(spark, folder, store.newest_months(spark, folder, 2))
        assert {r["month"] for r in sales.monthly_revenue(recent).collect()} == {"2025-09", "2025-10"}
    assert len(store.whole_batches(spark, folder)) == 3


@pytest.mark.parametrize("job", [
    forecast.monthly_ordinal, forecast.monthly_trend, sales.category_revenue,
    lambda t: churn.churn_label_90d(t, cutoff="2025-07-01"),
])
def test_only_the_folders_of_the_months_are_scanned(spark, tmp_path, job):
    folder = str(tmp_path)
    _store(spark, folder)
    store.write_by_month(spark, folder, "2")
    some = store.read_months(spark, folder, "2025-08")
    text = job(some)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.split("\n") if "FileScan" in line and "month" in line]
    assert scans and all("PartitionFilters: [" in line and "month" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_one_month_is_one_folder(spark, tmp_path):
    folder = str(tmp_path)
    _store(spark, folder)
    store.write_by_month(spark, folder, "2")
    for first in ("2025-10", store.newest_months(spark, folder, 1)):
        orders = store.read_months(spark, folder, first).orders
        assert orders.filter("order_date < '2025-10-01'").isEmpty() and _folders_read(orders) == [1]


def _folders_read(frame):
    """How many partitions each scan by month has read."""
    frame.collect()
    found, left = [], [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
        metric = node.metrics().get("numPartitions")
        if metric.isDefined():
            found.append(metric.get().value())
        left += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_rows_of_a_server_take_the_fixed_types(spark):
    rows = spark.sql("""select cast(1 as int) ORDER_ID, cast(2 as smallint) customer_id, timestamp'2025-01-02 03:04:05' order_date,
        'x' order_status, cast(12.50 as decimal(10,2)) total_amount, 'more' note""")
    from cartlight import schemas

    got = jdbc.conformed(rows, "orders")
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in schemas.schema("orders")]
    assert str(got.first()["order_date"]) == "2025-01-02" and got.first()["total_amount"] == 12.5
    with pytest.raises(ValueError, match="total_amount"):
        jdbc.conformed(rows.drop("total_amount"), "orders")
