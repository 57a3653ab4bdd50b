"""Versions, merges and as-of lookups against plain Python."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cartlight.operators import history, ingest
from tests.seed import product, shop

DAY = timedelta(days=1)
START = date(2024, 1, 15)
CHANGES = "product_id bigint, valid_from date, price double"


def draw_changes(seed, n, products=5, days=400):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, *range(products)]), START + rng.randrange(days) * DAY, float(rng.randrange(9))) for _ in range(n)]


def plain_versions(rows):
    best = {}
    for key, at, price in rows:
        if key is not None and at is not None:
            best[key, at] = max(price, best.get((key, at), price))
    times = {}
    for key, at in sorted(best):
        times.setdefault(key, []).append(at)
    return sorted(
        (key, at, best[key, at], next((t for t in times[key] if t > at), None)) for key, at in best
    )


def rows(frame):
    return sorted(tuple(r) for r in frame.select("product_id", "valid_from", "price", "valid_to").collect())


def test_versions(spark):
    changes = draw_changes(1, 300) + [(None, START, 1.0), (3, None, 1.0), (77, START, 2.0)]
    assert rows(history.versions(spark.createDataFrame(changes, CHANGES), ["product_id"])) == plain_versions(changes)
    assert rows(history.versions(spark.createDataFrame([], CHANGES), ["product_id"])) == []


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1], [1, 2, 0]])
def test_merging_in_any_order_is_the_same_as_all_at_once(spark, order):
    changes = sorted(set((k, d) for k, d, _ in draw_changes(2, 250)))
    priced = [(k, d, float(i % 7)) for i, (k, d) in enumerate(changes)]
    random.Random(3).shuffle(priced)
    batches = [spark.createDataFrame(priced[k::3], CHANGES) for k in order]
    stored = history.versions(batches[0], ["product_id"])
    for batch in batches[1:]:
        stored = history.merge_versions(stored, batch, ["product_id"])
    assert rows(stored) == plain_versions(priced)


def test_a_correction_replaces_and_untouched_keys_stay(spark):
    stored = history.versions(spark.createDataFrame([(1, START, 9.0), (1, START + 40 * DAY, 5.0), (2, START, 3.0)], CHANGES), ["product_id"])
    got = history.merge_versions(stored, spark.createDataFrame([(1, START, 4.0), (1, START - DAY, 1.0)], CHANGES), ["product_id"])
    assert rows(got) == [
        (1, START - DAY, 1.0, START), (1, START, 4.0, START + 40 * DAY), (1, START + 40 * DAY, 5.0, None), (2, START, 3.0, None)]
    again = history.merge_versions(got, spark.createDataFrame([], CHANGES), ["product_id"])
    assert rows(again) == rows(got)


def test_as_of_against_plain_python(spark):
    rng = random.Random(4)
    changes = draw_changes(5, 200)
    facts = [(k, rng.choice([None, 1, 1, 1, 2, 3, 8]), rng.choice([None, START + rng.randrange(-30, 500) * DAY])) for k in range(400)]
    facts += [(1000 + k, 1, START + 33 * DAY) for k in range(300)]  # many facts of one key and day
    frame = spark.createDataFrame(facts, "n int, product_id bigint, day date")
    got = history.as_of(frame, spark.createDataFrame(changes, CHANGES), ["product_id"], "day")
    assert got.columns == ["n", "product_id", "day", "valid_from", "price"]
    best = {(k, at): price for k, at, price, _ in plain_versions(changes)}
    for r in got.collect():
        times = [at for k, at in best if k == r["product_id"] and r["day"] is not None and at <= r["day"]]
        assert (r["valid_from"], r["price"]) == ((max(times), best[r["product_id"], max(times)]) if times else (None, None))
    assert got.count() == len(facts)


def test_as_of_with_times_of_day_and_two_keys(spark):
    at = datetime(2024, 5, 31, 23, 59)
    changes = spark.createDataFrame(
        [("a", 1, at, 1.0), ("a", 1, at + timedelta(minutes=2), 2.0), ("b", 1, at, None)], "shop string, product_id int, valid_from timestamp, price double")
    facts = spark.createDataFrame(
        [(k, s, 1, at + timedelta(minutes=m)) for k, (s, m) in enumerate([("a", -1), ("a", 0), ("a", 1), ("a", 2), ("a", 90_000), ("b", 9), ("c", 9)])],
        "n int, shop string, product_id int, asked timestamp")
    got = history.as_of(facts, changes, ["shop", "product_id"], "asked").orderBy("n").collect()
    assert [r["price"] for r in got] == [None, 1.0, 1.0, 2.0, 2.0, None, None]
    assert [r["valid_from"] is None for r in got] == [True, False, False, False, False, False, True]


def test_no_range_join_and_no_window_over_facts(spark):
    """Facts meet the found prices by equality, and where they share a key and day the join can be split."""
    facts = spark.range(1000).select((F.col("id") % 3).alias("product_id"), F.lit(START).alias("day"), "id")
    plan = history.as_of(facts, spark.createDataFrame([(1, START, 2.0)], CHANGES), ["product_id"], "day")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "NestedLoop" not in text and "Cartesian" not in text and "HashJoin" in text or "SortMergeJoin" in text


def test_orders_are_priced_on_their_day(spark):
    tables = shop(spark, products=[product(1, "a", 1, 50.0), product(2, "b", 1, 60.0)])
    prices = spark.createDataFrame([(1, START, 10.0), (1, START + 9 * DAY, 20.0)], CHANGES)
    asked = [("7", "1", "2", str(START + 3 * DAY)), ("7", "1", "1", str(START + 9 * DAY)), ("7", "1", "1", str(START - DAY)), ("7", "2", "1", str(START)), ("7", "9", "1", str(START))]
    batch = spark.createDataFrame([(*a, None) for a in asked], "customer_id string, product_id string, quantity string, order_date string, order_status string")
    good, bad = ingest.priced_orders(batch, tables, history=prices)
    assert sorted((str(r["order_date"]), r["unit_price"], r["total_amount"]) for r in good.collect()) == sorted([
        (str(START + 3 * DAY), 10.0, 20.0), (str(START + 9 * DAY), 20.0, 20.0), (str(START - DAY), 50.0, 50.0), (str(START), 60.0, 60.0)])
    assert [r["product_id"] for r in bad.collect()] == ["9"]


def test_stored_versions_that_come_twice_count_once(spark):
    """The greatest of them, as among changes; a change at their time replaces both."""
    twice = [(1, START, 9.0, None), (1, START, 7.0, None), (2, START, 3.0, None), (2, START, 4.0, None), (3, START, 1.0, None)]
    stored = spark.createDataFrame(twice, f"{CHANGES}, valid_to date")
    batch = spark.createDataFrame([(1, START + DAY, 5.0), (2, START, 1.0), (2, None, 8.0), (None, START, 8.0)], CHANGES)
    assert rows(history.merge_versions(stored, batch, ["product_id"])) == [
        (1, START, 9.0, START + DAY), (1, START + DAY, 5.0, None), (2, START, 1.0, None), (3, START, 1.0, None)]



def test_days_of_sparse_keys_share_a_bucket(spark):
    """Nearly every change lies in a month of its own: what crosses buckets is a row per key and decade, not per change."""
    days = [(k, START + 31 * k * DAY, 1.0) for k in range(60)]
    changes = spark.createDataFrame([(key, at, price) for key in range(5) for _, at, price in days], CHANGES)
    assert history._bucketed(changes, "valid_from", None).select("product_id", "_bucket").distinct().count() == 5
    assert history._bucketed(changes.withColumn("valid_from", F.col("valid_from").cast("timestamp")), "valid_from", None).select(
        "product_id", "_bucket").distinct().count() > 5 * 50
    plain = plain_versions([tuple(r) for r in changes.collect()])
    for bucket in (None, history.month, lambda at: at):
        assert rows(history.versions(changes, ["product_id"], bucket=bucket)) == plain


def test_merged_query_reads_the_sales_once(spark, monkeypatch):
    from cartlight.plans import registry

    asked = []
    changes = draw_changes(6, 60)
    frame = spark.createDataFrame([(k, d, p) for (k, d), p in {(k, d): p for k, d, p in changes}.items()], CHANGES)
    monkeypatch.setattr(registry, "materialize", lambda df: asked.append(df) or history.materialize(df))
    monkeypatch.setattr(history, "price_changes", lambda tables: frame)
    got = registry._price_history_merged(shop(spark))
    assert asked[0] is frame and rows(got) == plain_versions([tuple(r) for r in frame.collect()])


def test_as_of_writes_only_what_is_read_again(spark, monkeypatch):
    """The times among the changes and what was found; orders that are priced are parsed and written once before."""
    written = []
    count = lambda df: written.append(df) or _write(df)
    _write = history.materialize
    monkeypatch.setattr(history, "materialize", count)
    monkeypatch.setattr(ingest, "materialize", count)
    prices = spark.createDataFrame([(1, START, 10.0)], CHANGES)
    batch = spark.createDataFrame([("7", "1", "2", str(START), None)], "customer_id string, product_id string, quantity string, order_date string, order_status string")
    good, _ = ingest.priced_orders(batch, shop(spark, products=[product(1, "a", 1, 50.0)]), history=prices)
    assert [r["unit_price"] for r in good.collect()] == [10.0] and len(written) == 3
    assert "_product" in written[0].columns
