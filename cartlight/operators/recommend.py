"""Recommendations from the categories a customer has bought in.

A product is shown, and de-duplicated, by its name, price and category (its "card"). Nothing here
pairs products with products: a customer's purchases are first reduced to one row per category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cartlight.functions.money import money
from cartlight.functions.ranking import dense_index, is_small, top_k, top_k_per
from cartlight.operators.common import orders_by_customer
from cartlight.session import materialize
from cartlight.tables import Tables

_CARD = ["product_name", "price", "category_name"]
_BY_RATING = (F.desc, "rating"), (F.desc, "price"), (F.asc, "product_name"), (F.asc, "category_name")


def _by_rating():
    return [direction(name) for direction, name in _BY_RATING]


def top_spender(tables: Tables) -> DataFrame:
    """The customer with the highest spending, cancelled orders included."""
    names = tables.customers.select("customer_id", "customer_name")
    spending = F.coalesce(money(F.col("spent_micros")), F.lit(0.0)).alias("total_spending")
    everyone = names.join(orders_by_customer(tables, None), "customer_id", "left")
    return top_k(
        everyone.select("customer_id", "customer_name", spending),
        1, F.desc("total_spending"), F.asc("customer_id"),
    )


def purchases(tables: Tables, orders: DataFrame | None = None) -> DataFrame:
    """(customer_id, product_id) of every order item; repeat purchases repeat."""
    buyers = (tables.orders if orders is None else orders).select("order_id", "customer_id")
    return (
        tables.order_items.select("order_id", "product_id")
        .join(buyers, "order_id")
        .select("customer_id", "product_id")
    )


def _bought_categories(tables: Tables, bought: DataFrame) -> DataFrame:
    """One row per customer and category: ``only_product`` is set where it is the single product bought there.

    Lowest and highest product tell that without a distinct, and both are pre-aggregated in the map tasks.
    """
    links = tables.products.select("product_id", "category_id")
    first, last = F.min("product_id"), F.max("product_id")
    return (
        bought.join(links, "product_id")
        .groupBy("customer_id", "category_id")
        .agg(F.when(first == last, first).alias("only_product"))
    )


def _cards(tables: Tables) -> DataFrame:
    """One row per category and card: the two best ratings and the product that holds the best one.

    The second rating is what remains of a card once its best product is left out; NULL with
    ``copies`` = 1 means nothing remains.
    """
    names = tables.categories.select("category_id", "category_name")
    card = ["category_id", "product_name", "price"]
    catalogue = tables.products.select("product_id", *card, "rating").join(names, "category_id")
    leading = top_k_per(catalogue, card, 2, [F.desc("rating"), F.asc("product_id")], "place")
    first = F.col("place") == 1
    return leading.groupBy(*card, "category_name").agg(
        F.max(F.when(first, F.col("product_id"))).alias("best_product"),
        F.max(F.when(first, F.col("rating"))).alias("best_rating"),
        F.max(F.when(~first, F.col("rating"))).alias("next_rating"),
        F.count(F.lit(1)).alias("copies"),
    )


def _siblings(tables: Tables, bought: DataFrame, n: int) -> DataFrame:
    """The n best cards per customer among the siblings of bought products.

    Every product of a category is a sibling of some bought one, except a product that is the only
    one bought there. So at most one card of a category drops or loses rank for a customer, and the
    n + 1 best cards of each category are enough for the n best of any customer. That list has n + 1
    rows per category; if its bytes are few it is broadcast. Then the narrow rows of a customer and category are
    moved to their customer first, and the wide cards are joined, grouped and ranked where they are.
    """
    leaders = materialize(top_k_per(
        _cards(tables), "category_id", n + 1, [F.desc("best_rating"), F.desc("price"), F.asc("product_name")], "place"
    ).drop("place"))
    left_out = F.coalesce(F.col("only_product") == F.col("best_product"), F.lit(False))
    here = is_small(leaders)
    categories = _bought_categories(tables, bought)
    joined = (
        categories.repartition("customer_id").join(F.broadcast(leaders), "category_id") if here
        else categories.join(leaders, "category_id")
    )
    candidates = (
        joined.filter(~left_out | (F.col("copies") > 1))
        .select(
            "customer_id", *_CARD,
            F.when(left_out, F.col("next_rating")).otherwise(F.col("best_rating")).alias("rating"),
        )
    )
    # At most n + 1 rows per customer and category; one shuffle serves both steps below.
    one_place = (candidates if here else candidates.repartition("customer_id")).groupBy("customer_id", *_CARD).agg(F.max("rating").alias("rating"))
    return top_k_per(one_place, "customer_id", n, _by_rating())


def reco_all_customers(tables: Tables, n: int = 5) -> DataFrame:
    """The n best siblings for every customer who has bought anything."""
    return _siblings(tables, purchases(tables), n).select("customer_id", "rank", *_CARD)


def reco_siblings_top_spender(tables: Tables, n: int = 5) -> DataFrame:
    """The n best siblings for the biggest spender."""
    who = top_spender(tables).select("customer_id").scalar()
    bought = purchases(tables, tables.orders.filter(F.col("customer_id") == who))
    return _siblings(tables, bought, n).select("rank", *_CARD).orderBy("rank")


def reco_popular(tables: Tables, n: int = 5) -> DataFrame:
    """The n best rated products of known categories."""
    names = tables.categories.select("category_id", "category_name")
    best = top_k(tables.products.join(names, "category_id"), n, F.desc("rating"), F.asc("product_id"))
    place = F.row_number().over(Window.orderBy(F.desc("rating"), F.asc("product_id"))).cast("bigint")
    return best.withColumn("rank", place).select("rank", *_CARD)


def recommendations(tables: Tables, n: int = 5) -> DataFrame:
    """Siblings for the biggest spender, or the popular products if there are none; nothing without customers.

    One plan: both lists (n rows each) are put together and the better kind present is kept.
    """
    both = reco_siblings_top_spender(tables, n).withColumn("kind", F.lit(0)).unionByName(
        reco_popular(tables, n).filter(tables.customers.exists()).withColumn("kind", F.lit(1))
    )
    everything = Window.partitionBy(F.lit(0))
    return (
        both.withColumn("best_kind", F.min("kind").over(everything))
        .filter(F.col("kind") == F.col("best_kind"))
        .select("rank", *_CARD)
        .orderBy("rank")
    )


def reco_with_fallback(tables: Tables, n: int = 5) -> DataFrame:
    """Siblings for every customer; customers without any get the popular products."""
    siblings = _siblings(tables, purchases(tables), n).select("customer_id", F.struct("rank", *_CARD).alias("own"))
    popular = reco_popular(tables, n).agg(F.collect_list(F.struct("rank", *_CARD))).scalar()
    everyone = tables.customers.select("customer_id").join(siblings, "customer_id", "full")
    shown = F.when(F.col("own").isNull(), popular).otherwise(F.array("own"))
    return everyone.select("customer_id", F.explode(shown).alias("p")).select("customer_id", "p.*")


def history_pairs(tables: Tables, customer_id: int | None = None, n: int = 5) -> DataFrame:
    """Products a customer bought together with another product of the same category, n names per customer.

    With at least two products in a category, all of them qualify: no pairs are formed.
    """
    orders = tables.orders if customer_id is None else tables.orders.filter(F.col("customer_id") == customer_id)
    details = tables.products.select("product_id", "product_name", "category_id")
    bought = purchases(tables, orders).join(details, "product_id").filter("category_id is not null")
    key = ["customer_id", "category_id"]
    names = bought.groupBy(*key, "product_name").agg(F.min("product_id").alias("lo"), F.max("product_id").alias("hi"))
    # The first n names of a category hold every name it can add to the first n of the customer, and the first two,
    # or two products of one name, show that it has several products. All of it in the partitions of one shuffle.
    by_name = [F.asc("product_name")]
    category = Window.partitionBy(*key)
    first_names = top_k_per(names.repartition(*key), key, max(n, 2), by_name)
    several = (F.count(F.lit(1)).over(category) > 1) | F.max(F.col("lo") < F.col("hi")).over(category)
    kept = first_names.withColumn("several", several).filter(F.col("several") & (F.col("rank") <= n))
    names = kept.select("customer_id", "product_name")
    return top_k_per(names.repartition("customer_id").distinct(), "customer_id", n, by_name)


def reco_unseen(tables: Tables, n: int = 5, near: int = 64, block: int = 1024) -> DataFrame:
    """The n best cards of a customer's categories that the customer has not bought, for every customer.

    Cards are numbered 1, 2, 3, ... within their category from best to worst. A customer with b
    bought cards in a category finds n unseen ones among the first n + b numbers, so the numbers
    asked for grow with the purchases, never with customers x catalogue. Where n plus the bought
    cards among the first ``near`` numbers stays within ``near``, that many numbers are enough.
    """
    best_first = [F.desc("best_rating"), F.desc("price"), F.asc("product_name")]
    placed = dense_index(_cards(tables), "position", [F.asc("category_id"), *best_first])
    starts = placed.groupBy("category_id").agg(F.min("position").alias("start"))
    cards = placed.join(starts, "category_id").select(
        "category_id", (F.col("position") - F.col("start") + 1).alias("place"),
        *_CARD, F.col("best_rating").alias("rating"),
    )
    # The place among all cards and, of those that look alike in several categories, the first such place.
    overall = dense_index(cards, "overall", [*_by_rating(), F.asc("category_id")])
    cards = materialize(overall.withColumn("card", F.min("overall").over(Window.partitionBy(*_CARD))))
    numbered = tables.products.select("product_id", "category_id", "product_name", "price").alias("p").join(
        cards.alias("c"),
        (F.col("p.category_id") == F.col("c.category_id"))
        & (F.col("p.product_name") == F.col("c.product_name"))
        & F.col("p.price").eqNullSafe(F.col("c.price")),
    ).select("p.product_id", "p.category_id", "c.place")
    key = ["customer_id", "category_id"]
    # Read twice below; the null filter makes both readings the same plan, so the exchange is reused.
    known = F.col("customer_id").isNotNull() & F.col("category_id").isNotNull() & F.col("place").isNotNull()
    owned = purchases(tables).join(numbered, "product_id").select(*key, "place").filter(known).distinct()
    # Ask for places 1 .. last, in blocks, so that a long list is spread over many tasks.
    asked = (
        owned.groupBy(*key)
        .agg(
            (F.count(F.lit(1)) + n).alias("last"),
            (F.count(F.when(F.col("place") <= near, 1)) + n).alias("near_last"),
        )
        .select(*key, F.when(F.col("near_last") <= near, F.col("near_last")).otherwise(F.col("last")).alias("last"))
        .select(*key, "last", F.explode(F.expr(f"sequence(0L, (last - 1) div {block})")).alias("block"))
        .repartition(*key, "block")
        .select(*key, F.explode(F.expr(f"sequence(block * {block} + 1, least((block + 1) * {block}, last))")).alias("place"))
    )
    unseen = asked.join(owned, [*key, "place"], "left_anti")
    nearest = top_k_per(unseen, key, n, [F.asc("place")]).drop("rank")
    # Nearly every customer asks for the same first places: those cards are broadcast if their bytes are few.
    # Up to the n best of a customer only numbers are moved; names and prices are looked up for those.
    head, tail = cards.filter(F.col("place") <= near), cards.filter(F.col("place") > near)
    numbers, place = ["category_id", "place", "overall", "card"], ["category_id", "place"]
    if is_small(head):
        found = nearest.filter(F.col("place") <= near).join(F.broadcast(head.select(*numbers)), place).unionByName(
            nearest.filter(F.col("place") > near).join(tail.select(*numbers), place))
    else:
        found = nearest.join(cards.select(*numbers), place)
    candidates = found.select("customer_id", "card", "overall")
    one_place = candidates.repartition("customer_id").groupBy("customer_id", "card").agg(F.min("overall").alias("overall"))
    best = top_k_per(one_place, "customer_id", n, [F.asc("overall")]).select("customer_id", "rank", "overall")
    return best.join(cards.select("overall", *_CARD), "overall").select("customer_id", "rank", *_CARD)
