"""Ranking figures, demand and cohorts against plain Python."""

from __future__ import annotations

import math
import random
import statistics

import pytest

from cartlight.operators import judging, segments
from tests.seed import item, order, product, shop


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def plain_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("parts", [1, 3, 1 << 16])
def test_auc_and_lift_with_ties(spark, monkeypatch, parts):
    monkeypatch.setattr(judging, "_PARTS", parts)
    rng = random.Random(6)
    rows = [(rng.choice([0.0, 0.5, 0.5, 1.0, round(rng.random(), 2)]), int(rng.random() < 0.3)) for _ in range(500)]
    odd = [(None, 1), (float("nan"), 0), (0.3, None), (0.2, 7)]
    got = judging.roc_auc(scored(spark, rows + odd), "score", "label").first()
    assert (got["positives"], got["negatives"]) == (sum(y for _, y in rows), sum(1 - y for _, y in rows))
    assert got["auc"] == pytest.approx(plain_auc(rows), abs=1e-12)
    expected = {}
    for s, y in rows:
        decile = 10 * sum(t > s for t, _ in rows) // len(rows) + 1
        n, p = expected.get(decile, (0, 0))
        expected[decile] = (n + 1, p + y)
    base = sum(y for _, y in rows) / len(rows)
    for r in judging.lift_by_decile(scored(spark, rows + odd), "score", "label").collect():
        n, p = expected.pop(r["decile"])
        assert (r["customers"], r["positives"]) == (n, p) and r["lift"] == pytest.approx(p / n / base)
    assert not expected


def test_one_kind_or_one_score(spark):
    assert judging.roc_auc(scored(spark, [(0.1, 1), (0.2, 1)]), "score", "label").first()["auc"] is None
    assert tuple(judging.roc_auc(scored(spark, []), "score", "label").first()) == (0, 0, None)
    assert judging.roc_auc(scored(spark, [(0.1, 1), (0.1, 0)]), "score", "label").first()["auc"] == 0.5
    assert [tuple(r)[:3] for r in judging.lift_by_decile(scored(spark, [(0.1, 1), (0.1, 0)]), "score", "label").collect()] == [(1, 2, 1)]


def test_reorder_points_are_those_of_gap_free_days(spark):
    orders = [order(k, 1, f"2025-03-{d:02d}", status=s) for k, (d, s) in enumerate([(1, "Delivered"), (4, "Delivered"), (4, "Shipped"), (9, "Delivered"), (20, "Cancelled")])]
    items = [item(0, 0, 1, 5), item(1, 1, 1, 2), item(2, 2, 1, 3), item(3, 3, 2, 7), item(4, 4, 1, 90)]
    tables = shop(spark, orders=orders, order_items=items, products=[product(1, "a", 1, 1.0), product(2, "b", 1, 1.0), product(3, "c", 1, 1.0)])
    got = {r["product_id"]: r for r in segments.reorder_points(tables, lead_days=4, service=2.0).collect()}
    for key, sold in ((1, [5, 0, 0, 5, 0, 0, 0, 0, 0]), (2, [0] * 8 + [7]), (3, [0] * 9)):
        mean, deviation = statistics.mean(sold), statistics.stdev(sold)
        assert got[key]["daily_mean"] == pytest.approx(mean) and got[key]["daily_deviation"] == pytest.approx(deviation)
        assert got[key]["reorder_point"] == pytest.approx(4 * mean + 2 * math.sqrt(4) * deviation)
        assert got[key]["reorder"] == (got[key]["stock_quantity"] <= got[key]["reorder_point"])
    none = segments.reorder_points(tables.replace(orders=tables.orders.limit(0))).first()
    assert none["daily_mean"] is None and none["reorder"] is None


def test_cohorts(spark):
    orders = [order(1, 1, "2024-12-05"), order(2, 1, "2024-12-25"), order(3, 1, "2025-02-01"), order(4, 2, "2024-12-31"), order(5, 3, "2025-02-02"),
              order(6, 3, None), order(7, 4, "2025-01-01", status="Cancelled")]
    got = [tuple(r) for r in segments.cohort_retention(shop(spark, orders=orders)).collect()]
    assert got == [("2024-12", 0, 2, 1.0), ("2024-12", 2, 1, 0.5), ("2025-02", 0, 1, 1.0)]
