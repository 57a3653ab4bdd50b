"""Recommendations against the plain definition, on a shop with copies, a hot customer and a hot category."""

import random
from collections import defaultdict

import pytest

from cartlight.operators import recommend
from tests.seed import customer, item, order, product, shop


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    names = [f"p{i}" for i in range(30)]
    products = []
    for key in range(160):
        category = 1 if key % 2 else draw.choice([2, 3, 4, None, 77])
        products.append(product(key, draw.choice(names), category, float(draw.choice([10, 20, 30])),
                                rating=draw.choice([None, 1.0, 2.5, 4.0, 4.5])))
    products += [product(500 + i, "copy", 2, 10.0, rating=5.0) for i in range(20)]
    # two categories with the same name
    categories = [(1, "A", None), (2, "B", None), (3, "B", None), (4, "D", None), (5, "empty", None)]
    keys = [p[0] for p in products]
    orders, items = [], []
    for o in range(120):
        who = 1 if o % 3 == 0 else draw.randint(2, 40)  # a third of all orders from one customer
        orders.append(order(o, who))
        for _ in range(draw.choice([0, 1, 1, 2, 6])):
            items.append(item(len(items), o, draw.choice(keys)))
    orders += [order(1000 + i, 100 + i) for i in range(30)]  # one purchase each
    items += [item(5000 + i, 1000 + i, keys[i * 6 % len(keys)]) for i in range(30)]
    return {
        "products": products, "categories": categories, "orders": orders, "order_items": items,
        "customers": [customer(k) for k in [*range(1, 41), *range(100, 130)]],
    }


@pytest.fixture(scope="module")
def tables(spark, rows):
    return shop(spark, **rows)


def bought_by(rows):
    who = {o[0]: o[1] for o in rows["orders"]}
    bought = defaultdict(set)
    for _, o, p, _, _ in rows["order_items"]:
        bought[who[o]].add(p)
    return bought


def best_five(cards):
    """cards: {(name, price, category): rating}"""
    def place(entry):
        (name, price, category), rating = entry
        return (rating is None, -(rating or 0), -price, name, category)

    return [card for card, _ in sorted(cards.items(), key=place)][:5]


def put(cards, card, rating):
    old = cards.get(card)
    cards[card] = rating if old is None else old if rating is None else max(old, rating)


def by_customer(df):
    got = defaultdict(list)
    for r in df.orderBy("customer_id", "rank").collect():
        got[r["customer_id"]].append((r["product_name"], r["price"], r["category_name"]))
        assert r["rank"] == len(got[r["customer_id"]])
    return dict(got)


def test_siblings_match_all_pairs(tables, rows):
    info = {p[0]: p for p in rows["products"]}
    names = {c[0]: c[1] for c in rows["categories"]}
    expected = {}
    for who, bought in bought_by(rows).items():
        cards = {}
        for p1 in bought:
            for p2, (_, name, category, price, _, _, rating) in info.items():
                if p1 != p2 and category in names and info[p1][2] == category:
                    put(cards, (name, price, names[category]), rating)
        if cards:
            expected[who] = best_five(cards)
    got = by_customer(recommend.reco_all_customers(tables))
    assert got == expected


def test_unseen_matches_plain_definition(tables, rows):
    info = {p[0]: p for p in rows["products"]}
    names = {c[0]: c[1] for c in rows["categories"]}
    expected = {}
    for who, bought in bought_by(rows).items():
        visited = {info[p][2] for p in bought if info[p][2] in names}
        owned = {(info[p][2], info[p][1], info[p][3]) for p in bought}
        cards = {}
        for _, name, category, price, _, _, rating in info.values():
            if category in visited and (category, name, price) not in owned:
                put(cards, (name, price, names[category]), rating)
        if cards:
            expected[who] = best_five(cards)
    for near, block in ((64, 1024), (7, 2), (0, 2)):
        assert by_customer(recommend.reco_unseen(tables, near=near, block=block)) == expected


def test_history_matches_all_pairs(tables, rows):
    info = {p[0]: p for p in rows["products"]}
    expected = {}
    for who, bought in bought_by(rows).items():
        found = {
            info[b][1] for a in bought for b in bought
            if a != b and info[a][2] is not None and info[a][2] == info[b][2]
        }
        if found:
            expected[who] = sorted(found)[:5]
    got = defaultdict(list)
    for r in recommend.history_pairs(tables).orderBy("customer_id", "rank").collect():
        got[r["customer_id"]].append(r["product_name"])
    assert dict(got) == expected
    one = recommend.history_pairs(tables, customer_id=1).orderBy("rank").collect()
    assert [r["product_name"] for r in one] == expected[1]


def test_fallback_reaches_everyone(tables, rows):
    got = by_customer(recommend.reco_with_fallback(tables))
    assert set(got) == {c[0] for c in rows["customers"]}


def test_unseen_moves_numbers_until_the_best_are_known(spark, tables, monkeypatch):
    """What is grouped by customer holds no name; the names come to the n best of a customer."""
    ranked = []
    real = recommend.top_k_per
    monkeypatch.setattr(recommend, "top_k_per", lambda df, *a, **k: ranked.append(df) or real(df, *a, **k))
    recommend.reco_unseen(tables).count()
    assert ranked[-1].columns == ["customer_id", "card", "overall"]
    assert not any(kind == "string" for _, kind in ranked[-1].dtypes)
