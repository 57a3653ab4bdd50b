"""What neither the sample shop nor the test tables show."""

import pytest

from cartlight.functions.parsing import iso_date, whole_number
from cartlight.operators import churn, customers, forecast, kpi, recommend, sales, segments, views
from tests.seed import customer, item, order, product, seed_rows, shop


@pytest.fixture(scope="module")
def odd(spark):
    """The sample shop plus a cancelled order, a NULL status, orphans and a customer without orders."""
    rows = seed_rows()
    rows["customers"] += [customer(11, "Goa"), customer(12, "Goa")]
    rows["orders"] += [
        order(101, 11, "2025-05-28", "Cancelled", 90000.0),
        order(102, 11, "2025-05-29", None, 50.0),
        order(103, 999, "2025-08-02", "Delivered", 500.0),
        order(104, 11, None, "Delivered", 7.0),
    ]
    rows["order_items"] += [
        item(101, 101, 7, 1, 32000.0), item(102, 102, 7, 1, 50.0), item(103, 103, 99, 1, 500.0),
    ]
    rows["products"] += [product(99, "Orphan", 99, 10.0, rating=5.0)]
    return shop(spark, **rows)


def test_excluded_status(odd):
    assert kpi.total_revenue(odd).first()["revenue"] == 218900.0 + 500.0 + 7.0
    assert kpi.total_orders(odd).first()[0] == 14
    assert 7 not in {r["product_id"] for r in sales.top_products(odd).collect()}
    spending = {r["customer_id"]: r["total_spending"] for r in customers.customer_profile(odd).collect()}
    assert spending[11] == 7.0
    assert kpi.total_revenue(odd, exclude_status=None).first()["revenue"] == 218900.0 + 90000.0 + 50.0 + 500.0 + 7.0


def test_included_status(odd):
    features = {r["customer_id"]: r for r in churn.churn_features(odd).collect()}
    assert (features[11]["total_orders"], features[11]["total_spending"]) == (3, 90057.0)
    assert tuple(features[12])[2:] == (0, 0.0, 0.0)
    assert recommend.top_spender(odd).first()["customer_id"] == 11
    # only the washing machine was bought in its category, so its sibling is left
    names = [r["product_name"] for r in recommend.reco_siblings_top_spender(odd).collect()]
    assert names == ["Microwave Oven"]


def test_orphans(odd):
    assert 103 not in {r["order_id"] for r in views.orders_list(odd).collect()}
    assert 999 not in {r["customer_id"] for r in sales.top_customers(odd, n=100).collect()}
    listed = {r["product_id"]: r["category_name"] for r in views.products_list(odd).collect()}
    assert listed[99] is None
    assert "Orphan" not in {r["product_name"] for r in recommend.reco_popular(odd).collect()}
    assert sum(r["revenue"] for r in sales.category_revenue(odd).collect()) == 220300.0


def test_orphan_buyers_are_nobody(odd):
    assert customers.repeat_rate(odd).first()["buyers"] == customers.customer_profile(odd).count()
    assert 999 not in {r["customer_id"] for r in segments.rfm_scores(odd).collect()}
    assert 999 not in {r["customer_id"] for r in churn.churn_label_90d(odd).collect()}


def test_small_and_missing_amounts(spark):
    def revenue(amounts):
        orders = [order(k, 1, "2025-05-01", total=a) for k, a in enumerate(amounts, 1)]
        return kpi.total_revenue(shop(spark, **{**seed_rows(), "orders": orders})).first()[0]

    assert revenue([0.004] * 1000) == 4.0
    assert revenue([0.125] * 8) == 1.0
    assert revenue([float("nan"), float("inf"), 2.5, None]) == 2.5


def test_two_payments_and_shipments(spark):
    rows = seed_rows()
    payment, shipment = list(rows["payments"][0]), list(rows["shipping"][0])
    rows["payments"] = [tuple(payment), (99, payment[1], payment[2], "Card", "Pending", 40.0)]
    rows["shipping"] = [tuple(shipment), (99, shipment[1], shipment[2], None, "In Transit", None)]
    tables = shop(spark, **rows)
    detail = {r["order_id"]: r for r in views.order_detail(tables).collect()}[payment[1]]
    assert (detail["payments"], detail["paid_amount"], detail["open_amount"]) == (2, payment[5], 40.0)
    assert (detail["shipments"], detail["undelivered"], detail["last_delivery_date"]) == (2, 1, shipment[3])
    assert views.order_payments(tables).count() == 2 and views.order_shipments(tables).count() == 2
    assert "SortAggregate" not in views.order_detail(tables)._jdf.queryExecution().executedPlan().toString()


def test_months(odd):
    months = [(r["month"], r["revenue"]) for r in sales.monthly_revenue(odd).collect()]
    assert months == [(None, 7.0), ("2025-05", 218900.0), ("2025-08", 500.0)]
    numbered = [(r["month"], r["month_number"]) for r in forecast.monthly_ordinal(odd).collect()]
    assert numbered == [("2025-05", 1), ("2025-08", 2)]
    filled = [(r["month"], r["month_number"], r["revenue"]) for r in forecast.monthly_ordinal(odd, True).collect()]
    assert filled == [("2025-05", 1, 218900.0), ("2025-06", 2, 0.0), ("2025-07", 3, 0.0), ("2025-08", 4, 500.0)]
    assert forecast.forecast_next(odd).first()["next_month_number"] == 3
    assert forecast.forecast_next(odd, True).first()["next_month_number"] == 5


def test_text_to_dates_and_numbers(spark):
    df = spark.createDataFrame(
        [("2025-06-01 10:00",), ("2025-6-1",), ("bad",), (None,), ("5",), ("5.0",), (" -3 ",)], "t string")
    got = df.select(iso_date(df.t).alias("d"), whole_number(df.t).alias("n")).collect()
    assert [str(r["d"]) for r in got] == ["2025-06-01", "None", "None", "None", "None", "None", "None"]
    assert [r["n"] for r in got] == [None, None, None, None, 5, None, -3]


def test_empty_shop(spark):
    empty = shop(spark)
    assert tuple(kpi.dashboard_kpis(empty).first()) == (0.0, 0, 0, 0)
    assert tuple(kpi.average_order_value(empty).first()) == (None, None)
    assert recommend.recommendations(empty).collect() == []
    assert recommend.reco_all_customers(empty).collect() == []
    assert recommend.reco_unseen(empty).collect() == []
    assert sales.top_products(empty).collect() == []
    stats = customers.spending_stats(empty).first()
    assert stats["count"] == 0 and stats["q50"] is None and stats["mean"] is None
    assert churn.churn_labels(empty).collect() == []
    assert churn.churn_split_counts(empty).collect() == []
    assert churn.churn_label_90d(empty).collect() == []
    with pytest.raises(ValueError):
        churn.fit_churn(churn.churn_labels(empty))
    with pytest.raises(ValueError):
        forecast.fit_forecast(empty)


def test_popular_without_customers(spark):
    rows = seed_rows()
    rows.update(customers=[], orders=[], order_items=[])
    assert recommend.recommendations(shop(spark, **rows)).collect() == []


def test_popular_fallback(spark):
    rows = seed_rows()
    rows.update(orders=[], order_items=[])
    got = recommend.recommendations(shop(spark, **rows)).collect()
    assert [r["product_name"] for r in got][:2] == ["Data Science Book", "Python Programming"]
    everyone = recommend.reco_with_fallback(shop(spark, **rows)).collect()
    assert len(everyone) == 50 and {r["rank"] for r in everyone} == {1, 2, 3, 4, 5}


def test_all_spending_zero(spark):
    rows = seed_rows()
    rows["orders"] = [order(o[0], o[1], o[2], o[3], 0.0) for o in rows["orders"]]
    tables = shop(spark, **rows)
    labelled = churn.churn_labels(tables)
    assert {r["churn"] for r in labelled.collect()} == {1}
    model = churn.fit_churn(labelled)
    assert model.one_class
    top = churn.top_risk(churn.score_churn(model, churn.churn_features(tables))).collect()
    assert [(r["customer_id"], r["risk_score"]) for r in top] == [(k, 100.0) for k in (1, 2, 3, 4, 5)]


def test_churn_window(spark):
    tables = shop(
        spark,
        customers=[customer(k) for k in (1, 2, 3, 4)],
        orders=[
            order(1, 1, "2025-01-01"), order(2, 1, "2025-03-01"),
            order(3, 2, "2025-01-15"), order(4, 2, "2025-06-15"),
            order(5, 3, "2025-02-10"), order(6, 4, "2025-01-02"),
        ],
    )
    got = {r["customer_id"]: r["churn"] for r in churn.churn_label_90d(tables, cutoff="2025-02-01").collect()}
    assert got == {1: 0, 2: 1, 4: 1}


def test_top_k_ties(spark):
    tables = shop(
        spark, customers=[customer(k) for k in range(1, 13)], orders=[order(k, 13 - k) for k in range(1, 13)])
    assert [r["customer_id"] for r in sales.top_customers(tables).collect()] == list(range(1, 11))


def test_totals_agree(odd):
    by_product = sum(r["revenue"] for r in sales.product_performance(odd).collect() if r["category_name"])
    by_category = sum(r["revenue"] for r in sales.category_revenue(odd).collect())
    assert by_product == by_category
    by_month = sum(r["revenue"] for r in sales.monthly_revenue(odd).collect())
    assert by_month == kpi.total_revenue(odd).first()["revenue"]
