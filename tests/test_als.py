"""Collaborative filtering scores all products of a customer's categories."""

import random
import time

import pytest

from cartlight.functions import best_scores
from cartlight.functions.best_scores import best_by_inner_product
from cartlight.operators import segments
from cartlight.plans import registry
from cartlight.session import collecting
from tests.seed import customer, item, order, product, shop

SEEKERS, ITEMS = "seeker bigint, grp bigint, u array<float>", "grp bigint, item bigint, v array<float>"


def brute(seekers, items, n):
    found = {}
    for who, grp, u in seekers:
        mine = found.setdefault(who, [])
        for g, key, v in items:
            if g is not None and g == grp:
                total = 0.0
                for a, b in zip(u, v):
                    total += a * b
                mine.append((-total, key))
    return {who: [key for _, key in sorted(rows)[:n]] for who, rows in found.items() if rows}


def found(frame):
    got = {}
    for r in frame.orderBy("seeker", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["seeker"], [])) + 1
        got[r["seeker"]].append(r["item"])
    return got


def halves(draw, n=2):
    return [draw.randint(-8, 8) / 8 for _ in range(n)]  # exact in float, many ties


@pytest.mark.parametrize("block,crowd", [(4, 7), (16, 4096), (512, 4096)])
def test_same_as_all_pairs(spark, block, crowd):
    """A hot group, ties, one item alone in its group, groups without items, seekers of several groups."""
    draw = random.Random(8)
    size = {1: 90, 2: 7, 3: 1, 4: 33, None: 5}
    items = [(g, 1000 - k, [1.0, 0.5] if k % 4 == 0 else halves(draw)) for k, g in enumerate(g for g, n in size.items() for _ in range(n))]
    seekers = []
    for who in range(60):
        u = [0.0, 0.0] if who == 5 else halves(draw)
        seekers += [(who, g, u) for g in ([1] if who < 40 else [2, 3] if who < 50 else [1, 4, None] if who < 58 else [9])]
    for n in (1, 5, 100):
        got = found(best_by_inner_product(spark.createDataFrame(seekers, SEEKERS), spark.createDataFrame(items, ITEMS), n, 2, block, crowd))
        assert got == brute(seekers, items, n)


def test_blocks_are_left_shut(spark):
    """Norms that fall off: a few blocks decide, and the result is that of all pairs."""
    draw = random.Random(5)
    items = [(k % 2, k, [x * 40 / (1 + k // 8) for x in halves(draw, 4)]) for k in range(2000)]
    seekers = [(who, g, [1.0 + x for x in halves(draw, 4)]) for who in range(50) for g in (0, 1)]
    opened = spark.sparkContext.accumulator(0)
    frame = best_by_inner_product(
        spark.createDataFrame(seekers, SEEKERS), spark.createDataFrame(items, ITEMS), 5, 4, block=10, opened=opened)
    assert found(frame) == brute(seekers, [(g, k, [float(_single(x)) for x in v]) for g, k, v in items], 5)
    assert 0 < opened.value < 0.15 * len(seekers) * 100  # a hundred blocks in each group


def _single(x):
    import numpy as np

    return np.float32(x)


def test_nothing_to_find(spark):
    none, some = spark.createDataFrame([], SEEKERS), spark.createDataFrame([(1, 1, [1.0])], SEEKERS)
    assert found(best_by_inner_product(none, spark.createDataFrame([(1, 2, [1.0])], ITEMS), 3, 1)) == {}
    assert found(best_by_inner_product(some, spark.createDataFrame([], ITEMS), 3, 1)) == {}
    assert best_scores.BLOCK > 1


def test_products_that_sell_little_are_scored(spark):
    """Two tastes within one category: the small group's products are none of the 20 best sold."""
    draw = random.Random(2)
    orders, items = [], []
    for who in range(40):
        orders.append(order(who, who))
        for key in draw.sample(range(30) if who < 32 else range(30, 60), 15):
            items.append(item(len(items), who, key, 20 if who < 32 else 5))
    tables = shop(
        spark, products=[product(k, f"p{k}", 1, 10.0) for k in range(60)], categories=[(1, "A", None)],
        orders=orders, order_items=items, customers=[customer(k) for k in range(40)],
    )
    rows = [r for r in segments.reco_als(tables).collect() if r["customer_id"] >= 32]
    assert len(rows) == 40 and all(r["product_id"] >= 30 for r in rows)


def judged(spark, seekers, items, lists, crowd):
    """``missed_items`` over full lists of n: (seeker, grp, u, low, lowest, held)."""
    rows = [(who, g, u, *(lists[who][0][-1] if len(lists[who][0]) == lists[who][1] else (None, None)), [i for _, i in lists[who][0]])
            for who, g, u in seekers]
    frame = spark.createDataFrame(rows, f"{SEEKERS}, low double, lowest bigint, held array<bigint>")
    return best_scores.missed_items(frame, spark.createDataFrame(items, ITEMS), 2, crowd).groupBy().sum().first()[0]


@pytest.mark.parametrize("crowd", [7, 16384])
def test_missed_items_are_counted_without_rows_of_pairs(spark, crowd):
    """Every list right: none missed; a list with its best item cut, a list that ends early: told to the item."""
    draw = random.Random(3)
    items = [(k % 3, 500 - k, halves(draw)) for k in range(240)] + [(None, 9, [1.0, 1.0])]
    seekers = [(who, g, u) for who in range(40) for u in [halves(draw)] for g in ((0, 1) if who % 2 else (2,))]
    value = {i: v for _, i, v in items}
    mine = {who: u for who, _, u in seekers}
    lists = {who: ([(sum(a * b for a, b in zip(mine[who], value[i])), i) for i in best], 5) for who, best in brute(seekers, items, 5).items()}
    assert judged(spark, seekers, items, lists, crowd) == 0
    full, n = lists[3]
    assert judged(spark, seekers, items, {**lists, 3: (full[1:], n - 1)}, crowd) == 1
    assert judged(spark, seekers, items, {**lists, 3: (full[:4], n)}, crowd) == 160 - 4
    assert judged(spark, seekers, items, {**lists, 2: ([], n)}, crowd) == 80


def test_summary_forms_no_rows_of_pairs(spark):
    """200 customers, two of whom are checked against 300 products: no step reads or writes a row per pair."""
    draw = random.Random(6)
    tables = shop(
        spark, products=[product(k, f"p{k}", k % 2, 10.0) for k in range(300)], categories=[(0, "A", None), (1, "B", None)],
        orders=[order(who, who) for who in range(200)], customers=[customer(k) for k in range(200)],
        order_items=[item(k, k % 200, draw.randrange(300), 1 + k % 3) for k in range(4000)],
    )
    frame = registry._als_summary(tables)
    assert frame.first().asDict() == {
        "customers": 200, "gaps": 0, "unordered": 0, "unknown_products": 0, "wrong_scores": 0, "missed": 0}
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "LeftAnti" not in plan


def test_crowds_are_few(spark):
    """Blocks are sent to every crowd of their group: many seekers make no more crowds than cores need, two groups 2 * parts."""
    draw = random.Random(4)
    blocks = best_scores.blocks_by_norm(spark.createDataFrame([(k % 2, k, halves(draw)) for k in range(40)], ITEMS), 2, 5)
    people = spark.range(200000).selectExpr("id as seeker", "id % 2 as grp", "array(1f, 0f) as u", "double('-inf') as bound")
    calls = []
    frame = best_scores._round(people, blocks, 1, 2, best_scores.CROWD, None, lambda df: calls.append(df) or df, 50)
    assert [r["salts"] for r in calls[0].collect()] == [1, 1] and frame.count() == 200000


def test_blocks_of_the_model_stay_small(spark, monkeypatch):
    """Ten blocks up to 40 million pairs, then blocks of 2 million; a model in many blocks is as sound as one in ten."""
    assert [segments.als_blocks(n) for n in (0, 36_000_000, 40_000_000)] == [10] * 3
    assert all(n / segments.als_blocks(n) <= 2_000_000 for n in (40_000_001, 216_000_000, 10**10))
    made = []

    class Seen(segments.ALS):
        def fit(self, counts):
            made.append((self.getNumUserBlocks(), self.getNumItemBlocks(), counts.count()))
            return super().fit(counts)

    for name, value in (("ALS", Seen), ("_MOST", 10), ("_PAIRS", 40)):
        monkeypatch.setattr(segments, name, value)
    draw = random.Random(12)
    tables = shop(
        spark, products=[product(k, f"p{k}", k % 2, 10.0) for k in range(60)], categories=[(0, "A", None), (1, "B", None)],
        orders=[order(who, who) for who in range(50)], customers=[customer(k) for k in range(50)],
        order_items=[item(k, k % 50, draw.randrange(60), 1 + k % 3) for k in range(1000)],
    )
    assert registry._als_summary(tables).first().asDict() == {
        "customers": 50, "gaps": 0, "unordered": 0, "unknown_products": 0, "wrong_scores": 0, "missed": 0}
    users, items, pairs = made[0]
    assert users == items == -(-pairs // 40) > 10


def test_the_driver_collects_garbage_meanwhile(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    runs = lambda: sum(bean.getCollectionCount() for bean in beans)
    before = runs()
    with collecting(spark, 0.1):  # the session does nothing else
        until = time.time() + 20
        while runs() < before + 3 and time.time() < until:
            time.sleep(0.1)
    ended = runs()
    assert ended >= before + 3
    time.sleep(1)
    assert runs() == ended
