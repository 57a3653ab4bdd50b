"""Figures kept from batches are those of a pass over all rows."""

from __future__ import annotations

import itertools

import pytest

from cartlight.operators import incremental, kpi, sales
from cartlight.sources import store
from tests.seed import customer, order, product, seed_tables


def _store(spark, folder, batches):
    for name, frames in batches:
        store.append_batch(frames, folder, name)


def _orders(spark, rows):
    from cartlight import schemas

    return spark.createDataFrame(rows, schemas.schema("orders"))


def test_refreshed_figures_equal_the_full_pass(spark, tmp_path):
    tables = seed_tables(spark)
    parts = [tables.orders.filter(f"order_id % 4 = {k}") for k in range(4)]
    dashboards, months = set(), set()
    for number, order_ in enumerate(itertools.islice(itertools.permutations(range(4)), 0, 24, 11)):
        folder, home = f"{tmp_path}/{number}/store", f"{tmp_path}/{number}/figures"
        for step, k in enumerate(order_):
            frames = {"orders": parts[k]}
            if step == 1:
                frames |= {"customers": tables.customers, "products": tables.products}
            store.append_batch(frames, folder, f"b{k}")
            if step != 2:  # two batches at once
                assert f"b{k}" in incremental.refresh(spark, folder, home)
        assert incremental.refresh(spark, folder, home) == []
        kept = incremental.read_partials(spark, home)
        dashboards.add(tuple(incremental.dashboard(kept).first()))
        months.add(tuple(tuple(r) for r in incremental.monthly(kept).collect()))
    assert dashboards == {tuple(kpi.dashboard_kpis(tables).first())}
    assert months == {tuple(tuple(r) for r in sales.monthly_revenue(tables).collect())}


def test_only_new_folders_are_scanned(spark, tmp_path):
    tables = seed_tables(spark)
    folder, home = f"{tmp_path}/store", f"{tmp_path}/figures"
    store.append(tables.orders.filter("order_id % 2 = 0"), folder, "orders")
    store.append_batch({"orders": tables.orders.filter("order_id % 2 = 1")}, folder, "one")
    assert sorted(incremental.refresh(spark, folder, home)) == ["(first)orders", "one"]
    store.append_batch({"orders": tables.orders.limit(3)}, folder, "two")
    made, names = incremental.new_partials(spark, folder, {"(first)orders", "one"})
    assert names == ["two"] and made.inputFiles() and all("/two/orders/" in f for f in made.inputFiles())


def test_a_failed_refresh_leaves_the_version_before(spark, tmp_path, monkeypatch):
    tables = seed_tables(spark)
    folder, home = f"{tmp_path}/store", f"{tmp_path}/figures"
    store.append_batch({"orders": tables.orders}, folder, "one")
    incremental.refresh(spark, folder, home)
    before = incremental.dashboard(incremental.read_partials(spark, home)).first()
    store.append_batch({"orders": tables.orders}, folder, "two")
    with monkeypatch.context() as m:
        m.setattr(store, "mark_whole", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            incremental.refresh(spark, folder, home)
    assert incremental.dashboard(incremental.read_partials(spark, home)).first() == before
    assert incremental.refresh(spark, folder, home) == ["two"]
    after = incremental.dashboard(incremental.read_partials(spark, home)).first()
    assert after["total_orders"] == 2 * before["total_orders"] and after["revenue"] == pytest.approx(2 * before["revenue"])


def test_sketches_and_odd_rows(spark, tmp_path):
    folder, home = f"{tmp_path}/store", f"{tmp_path}/figures"
    with pytest.raises(ValueError):
        incremental.read_partials(spark, home)
    assert incremental.refresh(spark, folder, home) == []
    rows = [order(k, k % 500, "2025-01-05", total=float(k % 1000)) for k in range(4000)]
    rows += [order(9000, 1, None, total=7.0), order(9001, 2, "2025-02-01", total=None), order(9002, 2, "2025-02-01", total=float("nan"))]
    frame = seed_tables(spark).orders.limit(0)
    made = spark.createDataFrame(rows, frame.schema)
    store.append_batch({"orders": made.filter("order_id % 2 = 0")}, folder, "even")
    incremental.refresh(spark, folder, home)
    store.append_batch({"orders": made.filter("order_id % 2 = 1")}, folder, "odd")
    incremental.refresh(spark, folder, home)
    kept = incremental.read_partials(spark, home)
    months = {r["month"]: r for r in incremental.buyers_and_amounts(kept).collect()}
    assert abs(months["2025-01"]["buyers"] - 500) <= 25 and abs(months["2025-01"]["median_amount"] - 500) <= 25
    assert months["2025-01"]["orders"] == 4000 and months["2025-02"]["orders"] == 2 and months[None]["orders"] == 1
    assert {r["month"]: r["revenue"] for r in incremental.monthly(kept).collect()}["2025-02"] is None
    assert incremental.dashboard(kept).first()["total_customers"] == 0
    assert customer and product
