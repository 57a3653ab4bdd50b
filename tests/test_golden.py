"""Expected answers on the sample shop."""

import pytest

from cartlight.operators import churn, customers, forecast, kpi, recommend, sales, views


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_headline_figures(seed):
    row = kpi.dashboard_kpis(seed).first()
    assert tuple(row) == (218900.0, 10, 10, 14)
    assert kpi.total_revenue(seed).first()["revenue"] == 218900.0
    assert kpi.total_orders(seed).first()[0] == kpi.total_customers(seed).first()[0] == 10
    assert kpi.total_products(seed).first()[0] == 14
    assert tuple(kpi.average_order_value(seed).first()) == (21890.0, 21890.0)


def test_top_products(seed):
    assert values(sales.top_products(seed), "product_id", "units_sold", "revenue") == [
        (1, 2, 130000.0), (2, 2, 60000.0), (8, 1, 12000.0), (4, 2, 3600.0), (6, 2, 3600.0),
        (12, 1, 3500.0), (11, 1, 2500.0), (3, 2, 2400.0), (13, 2, 1000.0), (9, 1, 900.0),
    ]


def test_category_revenue(seed):
    assert values(sales.category_revenue(seed), "category_name", "revenue") == [
        ("Electronics", 196000.0), ("Home Appliances", 12000.0), ("Sports", 6000.0),
        ("Clothing", 4400.0), ("Beauty", 1000.0), ("Books", 900.0),
    ]


def test_monthly_revenue(seed):
    assert values(sales.monthly_revenue(seed), "month", "revenue") == [("2025-05", 218900.0)]


def test_top_customers(seed):
    assert values(sales.top_customers(seed), "customer_id", "spending") == [
        (6, 67000.0), (1, 66200.0), (2, 30800.0), (8, 30000.0), (4, 12000.0),
        (7, 4200.0), (5, 3500.0), (3, 2500.0), (9, 1800.0), (10, 900.0),
    ]


def test_customer_reports(seed):
    best = customers.best_customer(seed).first()
    assert (best["customer_id"], best["total_orders"], best["total_spending"]) == (6, 1, 67000.0)
    assert values(customers.customer_profile(seed), "customer_id")[:2] == [6, 1]
    assert customers.repeat_customers(seed).count() == 0
    assert tuple(customers.repeat_rate(seed).first()) == (10, 0, 0.0)


def test_spending_stats(seed):
    row = customers.spending_stats(seed).first()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (10, 21890.0, 900.0, 67000.0)
    assert (row["q25"], row["q50"], row["q75"]) == (2750.0, 8100.0, 30600.0)
    assert row["std"] == pytest.approx(26060.93074145878, rel=1e-12)


def test_high_value_customers(seed):
    got = customers.high_value_customers(seed, quantile=0.75).collect()
    assert [r["customer_id"] for r in got] == [6, 1, 2]
    assert got[0]["revenue_share"] == pytest.approx(67000 / 218900)


def test_city_revenue(seed):
    assert values(sales.city_revenue(seed), "city", "revenue") == [
        ("Kolkata", 133200.0), ("Delhi", 30800.0), ("Pune", 30000.0), ("Mumbai", 12000.0), ("Bangalore", 4200.0),
        ("Ahmedabad", 3500.0), ("Siliguri", 2500.0), ("Patna", 1800.0), ("Guwahati", 900.0),
    ]


def test_payment_methods(seed):
    assert values(sales.payment_methods(seed), "payment_method", "payments", "amount", "open_payments") == [
        ("Credit Card", 2, 97800.0, 0), ("UPI", 5, 77300.0, 0), ("Net Banking", 1, 30000.0, 0),
        ("Debit Card", 1, 12000.0, 0), ("Cash on Delivery", 1, 1800.0, 1),
    ]


def test_stock_and_ratings(seed):
    assert values(sales.low_stock(seed, 30), "product_id", "stock_quantity") == [(7, 20), (1, 25), (8, 30)]
    rated = sales.product_ratings(seed).filter("reviews > 0")
    assert sorted(values(rated, "product_id", "review_rating", "reviews")) == [
        (1, 5.0, 2), (2, 4.5, 2), (3, 4.0, 1), (5, 4.0, 1), (8, 4.0, 1), (9, 5.0, 1), (11, 4.0, 1), (12, 5.0, 1),
    ]
    sheet = {r["product_id"]: r for r in sales.product_performance(seed).collect()}
    assert len(sheet) == 14
    assert (sheet[7]["units_sold"], sheet[7]["revenue"]) == (0, 0.0)
    assert (sheet[1]["units_sold"], sheet[1]["revenue"], sheet[1]["category_name"]) == (2, 130000.0, "Electronics")


def test_list_views(seed):
    assert values(views.customers_list(seed), "customer_id") == list(range(10, 0, -1))
    assert values(views.products_list(seed), "product_id", "category_name")[0] == (14, "Beauty")
    assert values(views.orders_list(seed), "order_id") == list(range(10, 0, -1))
    assert values(views.category_lookup(seed), "category_name")[:2] == ["Beauty", "Books"]
    assert values(views.product_lookup(seed), "product_name")[0] == "Cricket Bat"
    assert values(views.customer_lookup(seed), "customer_name")[0] == "Customer 1"


def test_order_detail(seed):
    rows = {r["order_id"]: r for r in views.order_detail(seed).collect()}
    off = {k: r["total_amount"] - r["items_amount"] for k, r in rows.items() if r["total_amount"] != r["items_amount"]}
    assert off == {2: -1000.0, 6: -1000.0, 7: 600.0}
    assert (rows[9]["paid_amount"], rows[9]["open_amount"], rows[9]["undelivered"]) == (0.0, 1800.0, 1)
    assert (rows[1]["paid_amount"], rows[1]["open_amount"], rows[1]["shipments"]) == (66200.0, 0.0, 1)
    assert views.order_lines(seed).count() == 16


def test_churn_labels(seed):
    labels = {r["customer_id"]: r["churn"] for r in churn.churn_labels(seed).collect()}
    assert {k for k, v in labels.items() if v == 1} == {3, 5, 7, 9, 10}


def test_split_counts(seed):
    assert values(churn.churn_split_counts(seed), "churn", "is_test", "customers") == [
        (0, False, 4), (0, True, 1), (1, False, 4), (1, True, 1)]


def test_fallback_top_risk(seed):
    assert values(churn.top_risk(churn.fallback_risk(seed)), "customer_id", "risk_score") == [
        (10, 98.7), (9, 97.3), (3, 96.3), (5, 94.8), (7, 93.7)]


def test_forecast(seed):
    assert tuple(forecast.forecast_next(seed).first()) == (2, 218900.0)
    report = forecast.forecast_report(seed).collect()
    assert [tuple(r) for r in report] == [("2025-05", 218900.0, 2, 218900.0)]


def test_forecast_line(spark):
    months = [("2025-01", 1, 50000.0), ("2025-02", 2, 55000.0), ("2025-03", 3, 61000.0), ("2025-04", 4, 65000.0)]
    fit = forecast.fit_line(spark.createDataFrame(months, "month string, month_number bigint, revenue double"))
    row = fit.first()
    assert (row["slope"], row["intercept"]) == (pytest.approx(5100.0), pytest.approx(45000.0))
    assert tuple(forecast.predict(fit).first()) == (5, 70500.0)


def test_recommendations(seed):
    assert recommend.top_spender(seed).first()["customer_id"] == 6
    expected = [
        ("Laptop", 65000.0, "Electronics"), ("Smartphone", 30000.0, "Electronics"),
        ("Wireless Mouse", 1200.0, "Electronics"), ("Keyboard", 1800.0, "Electronics"),
    ]
    columns = ("product_name", "price", "category_name")
    assert values(recommend.reco_siblings_top_spender(seed), *columns) == expected
    assert values(recommend.recommendations(seed), *columns) == expected
    assert values(recommend.reco_popular(seed), "product_name") == [
        "Data Science Book", "Python Programming", "Laptop", "Washing Machine", "Running Shoes"]
    assert set(values(recommend.history_pairs(seed, customer_id=1), "product_name")) == {"Laptop", "Wireless Mouse"}
    unseen = recommend.reco_unseen(seed).filter("customer_id = 6")
    assert values(unseen, "product_name") == ["Smartphone"]
