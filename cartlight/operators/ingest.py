"""Batches of form-like rows checked, completed and numbered before they are appended.

Each function returns (accepted, rejected); a rejected row keeps its input columns and a reason.
Input columns are text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartlight.functions.parsing import blank_to_null, iso_date, number, whole_number
from cartlight.functions.ranking import dense_index, top_k_per
from cartlight.operators.history import as_of
from cartlight.session import materialize
from cartlight.tables import Tables

REASON = "reject_reason"
DEFAULT_COUNTRY = "India"
DEFAULT_STATUS = "Pending"


def _split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return judged.filter(F.col(REASON).isNull()).drop(REASON), judged.filter(F.col(REASON).isNotNull())


def _first_reason(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])


def _largest(existing: DataFrame, key: str) -> int:
    """The largest id stored now, read once: what is appended later does not move ids already given."""
    return existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).first()[0]


def with_new_ids(rows: DataFrame, key: str, existing: DataFrame) -> DataFrame:
    """Give rows the ids after the largest existing one, without gaps.

    The rows are written to the checkpoint folder, so their ids are the same however often they are read.
    """
    start = _largest(existing, key)
    return dense_index(rows, "_place").withColumn(key, F.lit(start) + F.col("_place") + 1).drop("_place")


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[str], arrival: list[str] | None = None) -> DataFrame:
    """Rows of the batch that are not stored yet, each natural key once. Loading a batch twice changes nothing.

    Keys match NULL with NULL. Of rows with equal keys the first by ``arrival`` is kept, ties decided by the other
    columns, so the order in which rows are read plays no part. Duplicates are cut in the map tasks before the shuffle.
    """
    order = [F.asc(c) for c in (arrival or [])] + [F.asc(c) for c in batch.columns if c not in keys]
    first = top_k_per(batch, keys, 1, order or [F.lit(0)], "_rank").drop("_rank")
    same = [first[k].eqNullSafe(existing[k]) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return first.join(existing.select(*keys), condition, "left_anti")


def ingest_customers(batch: DataFrame, tables: Tables, arrival: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """Name and e-mail are required; the first row of an e-mail wins, in the batch (by ``arrival``) and over it.

    A later row of an e-mail, or one that is stored already, is rejected like any other: every row of the batch is
    either accepted or rejected. The country defaults, a blank age is NULL, the registration date is today.

    The batch is written once with row numbers. The first row of an e-mail is cut out in the map tasks, and what it
    decides comes back by row number, so an e-mail on a third of the rows does not gather in a task.
    """
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("phone", "city", "state", "gender")}
    prepared = materialize(batch.withColumn("_row", F.monotonically_increasing_id())).withColumns({
        "_name": blank_to_null(F.col("customer_name")),
        "_email": blank_to_null(F.col("email")),
        "_age": blank_to_null(F.col("age")),
    })
    judged = prepared.withColumn(REASON, _first_reason(
        (F.col("_name").isNull() | F.col("_email").isNull(), "name and email are required"),
        (F.col("_age").isNotNull() & whole_number(F.col("_age")).try_cast("int").isNull(), "age is not a whole number"),
    ))
    sound, rejected = _split(judged)
    known = tables.customers.filter("email is not null").select(F.col("email").alias("_email"))
    order = [F.asc(arrival), *[F.asc(c) for c in batch.columns if c != arrival], F.asc("_row")]
    first = top_k_per(sound, "_email", 1, order, "_rank").select("_email", "_row")
    winners = materialize(first.join(known, "_email", "left_anti").select("_row"))
    fresh = sound.join(winners, "_row", "left_semi")
    taken = sound.join(winners, "_row", "left_anti").withColumn(REASON, F.lit("email is taken"))
    columns = [*batch.columns, REASON]
    rejected = rejected.select(*columns).unionByName(taken.select(*columns))
    numbered = with_new_ids(
        fresh.select(
            F.col("_name").alias("customer_name"),
            F.col("_email").alias("email"),
            text["phone"].alias("phone"), text["city"].alias("city"), text["state"].alias("state"),
            F.coalesce(blank_to_null(F.col("country")), F.lit(DEFAULT_COUNTRY)).alias("country"),
            F.current_date().alias("registration_date"),
            text["gender"].alias("gender"),
            whole_number(F.col("_age")).try_cast("int").alias("age"),
        ),
        "customer_id", tables.customers,
    )
    return numbered, rejected


def ingest_products(batch: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Name and category are required; blank price, stock and rating are 0; text that is no number is rejected."""
    name = blank_to_null(F.col("product_name"))
    given = {c: blank_to_null(F.col(c)) for c in ("category_id", "price", "stock_quantity", "rating")}
    category = whole_number(given["category_id"])
    stock = whole_number(given["stock_quantity"]).try_cast("int")
    judged = batch.withColumn(REASON, _first_reason(
        (name.isNull() | given["category_id"].isNull(), "name and category are required"),
        (category.isNull(), "category_id is not a whole number"),
        (given["price"].isNotNull() & number(given["price"]).isNull(), "price is not a number"),
        (given["stock_quantity"].isNotNull() & stock.isNull(), "stock_quantity is not a whole number"),
        (given["rating"].isNotNull() & number(given["rating"]).isNull(), "rating is not a number"),
    ))
    sound, rejected = _split(judged)
    typed = sound.select(
        name.alias("product_name"),
        category.alias("category_id"),
        F.coalesce(number(given["price"]), F.lit(0.0)).alias("price"),
        F.coalesce(stock, F.lit(0)).alias("stock_quantity"),
        F.trim(F.coalesce(F.col("brand"), F.lit(""))).alias("brand"),
        F.coalesce(number(given["rating"]), F.lit(0.0)).alias("rating"),
    )
    return with_new_ids(typed, "product_id", tables.products), rejected


def priced_orders(
    batch: DataFrame, tables: Tables, strict_customers: bool = False, history: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Check order requests and price them, without numbering them yet.

    The price is the current one of the catalogue or, with a price ``history`` (product_id, valid_from, price), the one
    that was valid on the day of the order, and the catalogue's where the history has none. Customer, product and a
    quantity above 0 are required and the product must exist. The customer is only checked with ``strict_customers``.
    """
    customer = blank_to_null(F.col("customer_id"))
    product = blank_to_null(F.col("product_id"))
    day = blank_to_null(F.col("order_date"))
    prepared = batch.withColumns({
        "_customer": whole_number(customer),
        "_product": whole_number(product),
        "_quantity": F.coalesce(whole_number(F.col("quantity")).try_cast("int"), F.lit(0)),
        "_day": F.when(day.isNull(), F.current_date()).otherwise(iso_date(day)),
    })
    prices = tables.products.select(
        F.col("product_id").alias("_product"), F.col("price").alias("_price"), F.lit(True).alias("_known")
    )
    joined = prepared.join(prices, "_product", "left")
    price = F.col("_price")
    if history is not None:
        joined = materialize(prepared).join(prices, "_product", "left")  # parsed once, read for the times and the rows
        valid = history.select(F.col("product_id").alias("_product"), "valid_from", F.col("price").alias("_then"))
        joined = as_of(joined, valid, ["_product"], "_day", "valid_from").drop("valid_from")
        price = F.coalesce("_then", "_price")
    incomplete = customer.isNull() | product.isNull() | (F.col("_quantity") <= 0)
    checks = [
        (incomplete, "customer, product and a valid quantity are required"),
        (F.col("_known").isNull(), "product not found"),
        (F.col("_customer").isNull(), "customer_id is not a whole number"),
        (F.col("_day").isNull(), "order_date is not a date"),
    ]
    if strict_customers:
        people = tables.customers.select(F.col("customer_id").alias("_customer"), F.lit(True).alias("_someone"))
        joined = joined.join(people, "_customer", "left")
        checks.append((F.col("_someone").isNull(), "customer not found"))
    sound, rejected = _split(joined.withColumn(REASON, _first_reason(*checks)))
    accepted = sound.select(
        F.col("_customer").alias("customer_id"),
        F.col("_product").alias("product_id"),
        F.col("_day").alias("order_date"),
        F.coalesce("order_status", F.lit(DEFAULT_STATUS)).alias("order_status"),
        F.col("_quantity").alias("quantity"),
        price.alias("unit_price"),
        (price * F.col("_quantity")).alias("total_amount"),
    )
    return accepted, rejected.select(*batch.columns, REASON)


def ingest_orders(
    batch: DataFrame, tables: Tables, strict_customers: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (orders, order_items, rejected) with new ids; an item keeps the price at order time.

    The ids are fixed when this is called: the numbered rows lie in the checkpoint folder and both starts are read
    once, so orders and items agree whatever is appended meanwhile. ``store.append_batch`` stores both as one.
    """
    accepted, rejected = priced_orders(batch, tables, strict_customers)
    first_order, first_item = _largest(tables.orders, "order_id"), _largest(tables.order_items, "order_item_id")
    numbered = with_new_ids(accepted, "order_id", tables.orders)
    orders = numbered.select("order_id", "customer_id", "order_date", "order_status", "total_amount")
    items = numbered.select(
        (F.col("order_id") + F.lit(first_item - first_order)).alias("order_item_id"), "order_id", "product_id",
        "quantity", "unit_price",
    )
    return orders, items, rejected


def upsert_by_key(
    current: DataFrame, changes: DataFrame, keys: list[str], version: str, deleted: str | None = None
) -> DataFrame:
    """The next snapshot of a table: per key the row with the highest ``version`` wins, a ``deleted`` one disappears.

    ``current`` rows lose against any change. Changes of a key with equal versions must not differ: of those that do,
    the smallest in the order of the columns wins, a deletion last, whatever order they are read in. Only one row
    per key and map task is shuffled.
    """
    columns = current.columns
    flag = F.col(deleted) if deleted else F.lit(False)
    old = current.select(
        *columns, F.lit(0).alias("_new"), F.lit(None).cast("bigint").alias("_version"), F.lit(False).alias("_gone")
    )
    new = changes.select(
        *columns, F.lit(1).alias("_new"), F.col(version).cast("bigint").alias("_version"), flag.alias("_gone")
    )
    order = [F.desc("_new"), F.desc("_version"), F.asc("_gone"), *[F.asc(c) for c in columns if c not in keys]]
    latest = top_k_per(old.unionByName(new), keys, 1, order)
    return latest.filter(~F.col("_gone")).select(*columns)
