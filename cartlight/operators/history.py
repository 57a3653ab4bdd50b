"""Values with a time of validity: versions kept by merging changes, and facts looked up at their own time.

Nothing here joins on a range or sorts a key's whole history in one task. Rows are put in order within a key and a
time bucket; what crosses from one bucket to the next is one row per key and bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from cartlight.operators.common import CANCELLED, kept_orders
from cartlight.session import materialize
from cartlight.tables import Tables


def month(at: Column) -> Column:
    return F.trunc(at.cast("date"), "MM")


def decade(at: Column) -> Column:
    return F.floor(F.year(at) / 10)


Bucket = Callable[[Column], Column]


def _bucketed(rows: DataFrame, at: str, bucket: Bucket | None) -> DataFrame:
    """``rows`` with ``_bucket``: if none is given by decade for days, of which a key has 3,653 there, else by month."""
    return rows.withColumn("_bucket", (bucket or (decade if rows.schema[at].dataType == DateType() else month))(F.col(at)))


def _points(changes: DataFrame, keys: list[str], since: str) -> DataFrame:
    """One change per key and time: of several the greatest by the other columns. Changes without key or time go."""
    values = [c for c in changes.columns if c not in (*keys, since)]
    known = changes.dropna(subset=[*keys, since])
    return known.groupBy(*keys, since).agg(F.max(F.struct(*values)).alias("_v")).select(
        *keys, since, *[F.col("_v").getField(c).alias(c) for c in values])


def versions(changes: DataFrame, keys: list[str], since: str = "valid_from", bucket: Bucket | None = None) -> DataFrame:
    """Every change of a key with ``valid_to``, the time of its next change; NULL for the present one.

    A change of the same value stays a version of its own, so that an earlier change that comes late is still ended by
    it.
    """
    return _ended(_points(changes, keys, since).withColumn("_new", F.lit(0)), keys, since, bucket)


def _ended(points: DataFrame, keys: list[str], since: str, bucket: Bucket | None) -> DataFrame:
    """Points of the columns of changes and ``_new`` as versions; of points at one time the last by _new and values stays.

    The next change within the bucket is found by windows over key and bucket, in one shuffle; only the last change of a
    bucket takes that of a later bucket, found by a window over the first changes of the buckets.
    """
    values = [c for c in points.columns if c not in (*keys, since, "_new")]
    place = Window.partitionBy(*keys, "_bucket")
    same = F.lead(since).over(place.orderBy(since, "_new", *values))
    inside = place.orderBy(since)
    single = _bucketed(points, since, bucket).withColumn("_next", same).filter(
        F.col("_next").isNull() | (F.col("_next") != F.col(since)))
    told = materialize(single.drop("_new").withColumn("_next", F.lead(since).over(inside)).withColumn(
        "_first", F.lag(since).over(inside).isNull()))
    starts = told.filter("_first").select(*keys, "_bucket", F.col(since).alias("_start"))
    later = starts.withColumn("_later", F.lead("_start").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_start")
    columns = [c for c in points.columns if c != "_new"]
    return told.filter("_next is not null").select(*columns, F.col("_next").alias("valid_to")).unionByName(
        told.filter("_next is null").join(later.filter("_later is not null"), [*keys, "_bucket"], "left").select(
            *columns, F.col("_later").alias("valid_to")))


def merge_versions(
    stored: DataFrame, changes: DataFrame, keys: list[str], since: str = "valid_from", bucket: Bucket | None = None
) -> DataFrame:
    """The versions after new changes, which may come late: only the keys they touch are worked out anew.

    A change at the time of a stored version replaces it. Merging changes batch by batch, in any order of their times,
    gives the same as all at once; of several changes at one time in a batch the greatest by the other columns counts.
    The changes are read twice, so pass a materialized frame if they are dear.
    """
    columns = [c for c in stored.columns if c != "valid_to"]
    touched = materialize(changes.select(*keys).dropna().distinct())
    new = _points(changes.select(*columns), keys, since).withColumn("_new", F.lit(1))
    old = stored.join(touched, keys, "left_semi").select(*columns).dropna(subset=[since]).withColumn("_new", F.lit(0))
    rebuilt = _ended(old.unionByName(new), keys, since, bucket)
    return stored.join(touched, keys, "left_anti").unionByName(rebuilt.select(*stored.columns))


def as_of(
    facts: DataFrame, changes: DataFrame, keys: list[str], at: str, since: str = "valid_from", bucket: Bucket | None = None
) -> DataFrame:
    """``facts`` with the columns of the latest change at or before the time ``at``; NULL where there is none.

    Every fact stays, also one without key or time. The distinct times of a key's facts are put among its changes and
    take the last one before them: within the bucket by a window over key and bucket, else, for the few times without
    one, that of the last earlier bucket that has one. Facts take theirs by an equi-join on key and time, which adaptive
    execution splits where many facts share them, because the times are written first.
    """
    values = [c for c in changes.columns if c not in keys]
    known = _points(changes, keys, since).select(
        *keys, F.col(since).alias("_at"), F.struct(*values).alias("_v"), F.lit(False).alias("_asks"))
    times = facts.select(*keys, F.col(at).alias("_at")).dropna().distinct().withColumn("_asks", F.lit(True))
    among = _bucketed(known.unionByName(times, allowMissingColumns=True), "_at", bucket)
    order = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_asks")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    told = materialize(
        among.withColumn("_end", F.lead("_at").over(order).isNull()).withColumn("_v", F.last("_v", ignorenulls=True).over(upto))
        .filter(F.col("_asks") | F.col("_end")))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = told.filter("_end").select(
        *keys, "_bucket", F.last("_v", ignorenulls=True).over(earlier).alias("_carried")).filter("_carried is not null")
    inside = told.filter("_asks and _v is not null").select(*keys, F.col("_at").alias(at), "_v")
    before = told.filter("_asks and _v is null").select(*keys, "_bucket", F.col("_at").alias(at)).join(
        carried, [*keys, "_bucket"]).select(*keys, at, F.col("_carried").alias("_v"))
    found = materialize(inside.unionByName(before))
    return facts.join(found, [*keys, at], "left").select(
        *[facts[c] for c in facts.columns], *[F.col("_v").getField(c).alias(c) for c in values])


def price_changes(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """(product_id, valid_from, price): the highest unit price that a product was sold at on a day."""
    days = kept_orders(tables, exclude_status).select("order_id", "order_date")
    sold = tables.order_items.select("order_id", "product_id", "unit_price").join(days, "order_id")
    return sold.filter("order_date is not null and unit_price is not null and product_id is not null").groupBy(
        "product_id", F.col("order_date").alias("valid_from")).agg(F.max("unit_price").alias("price"))


def price_history(tables: Tables) -> DataFrame:
    """(product_id, valid_from, price, valid_to) from the prices that products were sold at."""
    return versions(price_changes(tables), ["product_id"])


def order_price_asof(tables: Tables) -> DataFrame:
    """Every order item beside the price that its product had on the eve of the order, and since when."""
    days = tables.orders.select("order_id", "order_date", F.date_sub("order_date", 1).alias("eve"))
    items = tables.order_items.select("order_id", "product_id", "quantity", "unit_price").join(days, "order_id")
    changes = price_changes(tables).select("product_id", F.col("valid_from").alias("price_since"), F.col("price").alias("price_before"))
    return as_of(items, changes, ["product_id"], "eve", "price_since").drop("eve")
