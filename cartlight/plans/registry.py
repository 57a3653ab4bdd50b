"""Every query by name: (spark, folder) -> DataFrame over the star-schema tables in ``folder``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartlight.functions.best_scores import missed_items
from cartlight.functions.money import money_sum
from cartlight.operators import (
    churn, customers, forecast, history, incremental, ingest, judging, kpi, recommend, sales, segments, views,
)
from cartlight.session import checkpoint_folder, materialize, prepare
from cartlight.sources import store
from cartlight.sources.starschema import event_schema, scan, shop_tables
from cartlight.streaming import realtime
from cartlight.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


def _over_shop(job: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: job(shop_tables(spark, folder))


def _order_requests(tables: Tables) -> DataFrame:
    """Every order item as a form-like order request: text columns."""
    orders = tables.orders.select("order_id", "customer_id", "order_date")
    return tables.order_items.select("order_id", "product_id", "quantity").join(orders, "order_id").select(
        *[F.col(c).cast("string") for c in ("customer_id", "product_id", "quantity", "order_date")],
        F.lit(None).cast("string").alias("order_status"),
    )


def _order_pricing(tables: Tables) -> DataFrame:
    return ingest.priced_orders(_order_requests(tables), tables)[0]


def _faulty_requests(tables: Tables) -> DataFrame:
    """Every order item as a request; some without quantity, some for unknown products, some on no day."""
    good = _order_requests(tables)
    product, customer = F.col("product_id").cast("bigint"), F.col("customer_id").cast("bigint")
    return good.withColumns({
        "quantity": F.when(customer % 5 == 0, "x").otherwise(F.col("quantity")),
        "product_id": F.when(product % 7 == 0, F.concat(F.lit("9000000000"), "product_id")).otherwise(F.col("product_id")),
        "order_date": F.when(customer % 11 == 0, "someday").otherwise(F.col("order_date")),
    })


def _order_rejects(tables: Tables) -> DataFrame:
    return ingest.priced_orders(_faulty_requests(tables), tables)[1]


def _numbered_orders(tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All items ordered anew, over items that have ids."""
    ids = tables.order_items.withColumn("order_item_id", F.col("order_id") * 10)
    return ingest.ingest_orders(_faulty_requests(tables), tables.replace(order_items=ids))


def _ingest_orders(tables: Tables) -> DataFrame:
    """Per customer and day the new orders, and how their ids lie: which order gets which id is free."""
    orders, _, _ = _numbered_orders(tables)
    return orders.groupBy("customer_id", "order_date", "order_status").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("order_id").alias("ids"),
        money_sum(F.col("total_amount")).alias("amount"),
    ).withColumn("above", orders.agg(F.min("order_id")).scalar() - 1).withColumn(
        "highest", orders.agg(F.max("order_id")).scalar())


def _ingest_order_items(tables: Tables) -> DataFrame:
    """Every new item beside the customer and day of the order it points to."""
    orders, items, _ = _numbered_orders(tables)
    joined = items.join(orders, "order_id")
    return joined.select(
        "customer_id", "order_date", "product_id", "quantity", "unit_price",
        (F.col("quantity") * F.col("unit_price") == F.col("total_amount")).alias("amount_agrees"),
        (F.col("order_item_id") - F.col("order_id")).alias("offset"),
    )


def _customer_forms(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Every customer as a form, twice, over a store that knows Asia already; Africa forgot the e-mail."""
    people = tables.customers
    blank = F.lit(None).cast("string")
    forms = people.select(
        F.col("customer_id").alias("arrival"),
        F.concat(F.lit("  "), "customer_name", F.lit(" ")).alias("customer_name"),
        F.when(F.col("state") == "AFRICA", " ").otherwise(F.col("email")).alias("email"),
        blank.alias("phone"), "city", "state", blank.alias("country"), blank.alias("gender"), F.lit("").alias("age"),
    )
    later = forms.withColumn("arrival", F.col("arrival") + 10**12).withColumn("customer_name", F.lit("too late"))
    stored = tables.replace(customers=people.filter("state = 'ASIA'"))
    return ingest.ingest_customers(forms.unionByName(later), stored)


def _ingest_customers(tables: Tables) -> DataFrame:
    return _customer_forms(tables)[0].drop("customer_id", "registration_date")


def _customer_rejects(tables: Tables) -> DataFrame:
    return _customer_forms(tables)[1].select("arrival", "customer_name", "email", "city", "state", ingest.REASON)


def _product_forms(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Every product as a form; scarce ones without price, one brand without names, one with a rating in words."""
    products = tables.products
    forms = products.select(
        F.when(products.brand == "Brand#1", "").otherwise(products.product_name).alias("product_name"),
        products.category_id.cast("string").alias("category_id"),
        F.when(products.stock_quantity < 5, " ").otherwise(products.price.cast("string")).alias("price"),
        products.stock_quantity.cast("string").alias("stock_quantity"),
        F.concat("brand", F.lit(" ")).alias("brand"),
        F.when(products.brand == "Brand#2", "good").otherwise(products.rating.cast("string")).alias("rating"),
    )
    return ingest.ingest_products(forms, tables)


def _ingest_products(tables: Tables) -> DataFrame:
    return _product_forms(tables)[0].drop("product_id")


def _product_rejects(tables: Tables) -> DataFrame:
    return _product_forms(tables)[1].select("product_name", "category_id", "stock_quantity", "brand", ingest.REASON)


def _surrogate_keys(tables: Tables) -> DataFrame:
    """New order ids, one row each, for as many rows as there are order items."""
    return ingest.with_new_ids(tables.order_items.select("product_id"), "order_id", tables.orders).select("order_id")


def _typing(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Every order as text, cancelled ones with a date that does not parse."""
    text = tables.orders.select(*[F.col(c).cast("string") for c in tables.orders.columns])
    day = F.when(F.col("order_status") == "Cancelled", "unknown").otherwise(F.concat("order_date", F.lit(" 10:00")))
    return store.typed(text.withColumn("order_date", day), "orders")


def _typed_orders(tables: Tables) -> DataFrame:
    return _typing(tables)[0]


def _typed_rejects(tables: Tables) -> DataFrame:
    return _typing(tables)[1].select("order_id", "customer_id", "order_date", "order_status", "reject_reason")


def _dedup_load(tables: Tables) -> DataFrame:
    """All orders loaded over a store that holds the delivered ones, each again later with another status."""
    stored = tables.orders.filter("order_status = 'Delivered'")
    batch = tables.orders.withColumn("arrival", F.lit(1)).unionByName(
        tables.orders.withColumn("order_status", F.lit("Late")).withColumn("arrival", F.lit(2)))
    return stored.unionByName(ingest.new_rows(batch, stored, ["order_id"], ["arrival"]).drop("arrival"))


def _segment_summary(tables: Tables) -> DataFrame:
    """What must hold of any segments: everybody has one, and nobody lies nearer to another segment's centre."""
    rows = materialize(segments.customer_clusters(tables).join(
        segments.standardized(tables), "customer_id").select("customer_id", "segment", *segments.SCALED))
    centres = rows.groupBy("segment").agg(*[F.avg(c).alias(f"_{c}") for c in segments.SCALED])
    own = F.aggregate(F.array(*[(F.col(c) - F.col(f"_{c}")) ** 2 for c in segments.SCALED]), F.lit(0.0), lambda s, x: s + x)
    table = centres.agg(F.collect_list(F.struct(*centres.columns))).scalar()  # one row a segment
    every = F.transform("centres", lambda m: sum(((F.col(c) - m[f"_{c}"]) ** 2 for c in segments.SCALED), F.lit(0.0)))
    return rows.join(F.broadcast(centres), "segment").withColumn("centres", table).agg(
        F.countDistinct("customer_id").alias("customers"), F.countDistinct("segment").alias("segments"),
        (F.avg(F.when(own <= F.array_min(every) + 1e-6, 1.0).otherwise(0.0)) >= 0.99).alias("at_nearest"),
    )


def _churn_summary(tables: Tables) -> DataFrame:
    """What must hold of the scores: everybody has one within 0 and 1, and those who spend least are most at risk."""
    scores = materialize(churn.churn_scores(tables))
    cut = scores.agg(F.avg("total_spending")).scalar()
    judged = scores.withColumn("cut", cut)
    return judged.agg(
        F.countDistinct("customer_id").alias("customers"),
        F.count_if(~F.col("churn_probability").between(0, 1)).alias("outside"),
        (F.avg(F.when(F.col("total_spending") <= F.col("cut"), F.col("churn_probability")))
         > F.avg(F.when(F.col("total_spending") > F.col("cut"), F.col("churn_probability")))).alias("falls_with_spending"),
    )


def _metrics_summary(kind: str) -> Callable[[Tables], DataFrame]:
    return lambda tables: churn.train_and_test(tables, kind)[1].select(
        "train_rows", "test_rows", (F.col("accuracy") >= 0.9).alias("accurate"))


def _als_summary(tables: Tables) -> DataFrame:
    """What must hold of the recommendations, by the factors they were made from.

    Ranks without gaps, known products, falling scores that are the products of the factors; and for customers whose id is
    divisible by 100, among all products of their categories none that should stand in the list and does not.
    """
    wanted, products, factors = segments.als_factors(tables)
    rows = materialize(segments.best_scored(wanted, products, 5, factors))
    score = F.aggregate(F.zip_with("u", "i", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    people = wanted.groupBy("customer_id").agg(F.any_value("u").alias("u"))
    known = rows.join(people, "customer_id").join(products, "product_id").agg(
        F.count(F.lit(1)).alias("known"), F.count_if(score != F.col("score")).alias("wrong"))
    per = materialize(rows.groupBy("customer_id").agg(
        F.max("rank").alias("last"), F.countDistinct("rank").alias("ranks"), F.countDistinct("product_id").alias("products"),
        F.max_by("score", -F.col("rank")).alias("top"), F.max("score").alias("best"), F.min("score").alias("low"),
        F.max_by("product_id", "rank").alias("lowest"), F.collect_set("product_id").alias("held"),
    ))
    asked = wanted.filter("customer_id % 100 = 0").join(per, "customer_id", "left").select(
        F.col("customer_id").alias("seeker"), F.col("category_id").alias("grp"), "u",
        F.when(F.col("last") >= 5, F.col("low")).alias("low"), "lowest", "held")
    items = products.select(F.col("category_id").alias("grp"), F.col("product_id").alias("item"), F.col("i").alias("v"))
    missed = missed_items(asked, items, factors).agg(F.coalesce(F.sum("missed"), F.lit(0)))
    return per.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if((F.col("last") != F.col("ranks")) | (F.col("ranks") != F.col("products")) | (F.col("last") > 5)).alias("gaps"),
        F.count_if(F.col("top") < F.col("best")).alias("unordered"),
        F.sum("ranks").alias("_all"),
    ).select(
        "customers", "gaps", "unordered", (F.col("_all") - known.select("known").scalar()).alias("unknown_products"),
        known.select("wrong").scalar().alias("wrong_scores"), missed.scalar().alias("missed"),
    )


def _upsert_latest(tables: Tables) -> DataFrame:
    """All products after two price changes each and the deletion of the scarce ones."""
    def change(rows: DataFrame, factor: float, version: int, gone: bool) -> DataFrame:
        return rows.withColumn("price", F.col("price") * factor).withColumn(
            "version", F.lit(version)).withColumn("gone", F.lit(gone))

    products = tables.products
    scarce = products.filter(F.col("stock_quantity") <= 5)
    changes = change(products, 3.0, 1, False).unionByName(change(products, 2.0, 2, False)).unionByName(
        change(scarce, 1.0, 3, True))
    return ingest.upsert_by_key(products, changes, ["product_id"], "version", "gone")


def _spending_stats(tables: Tables) -> DataFrame:
    return customers.spending_stats(tables).withColumn("std", F.round("std", 4))


def _forecast_fit(tables: Tables) -> DataFrame:
    fit = forecast.fit_line(forecast.monthly_ordinal(tables))
    return fit.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "months")


def _order_pricing_asof(tables: Tables) -> DataFrame:
    return ingest.priced_orders(_order_requests(tables), tables, history=history.price_changes(tables))[0]


def _price_history_merged(tables: Tables) -> DataFrame:
    """The price history from three batches: wrong prices first, the odd days, then the even days and the corrections."""
    changes = materialize(history.price_changes(tables))  # read for every batch
    odd = F.dayofmonth("valid_from") % 2 == 1
    wrong = changes.filter(odd).withColumn("price", F.col("price") + 1.0)
    stored = materialize(history.versions(wrong, ["product_id"]))
    stored = materialize(history.merge_versions(stored, changes.filter(odd), ["product_id"]))
    return history.merge_versions(stored, changes.filter(~odd), ["product_id"])


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Partials of a store that all orders, customers and products were loaded into in four batches, refreshed twice."""
    tables = shop_tables(spark, folder)
    run = f"{checkpoint_folder(spark)}/incremental-{uuid.uuid4().hex}"
    part = lambda k: tables.orders.filter(F.pmod("order_id", F.lit(3)) == k)
    store.append_batch({"orders": part(2), "customers": tables.customers}, f"{run}/store", "c")
    store.append_batch({"orders": part(0)}, f"{run}/store", "a")
    incremental.refresh(spark, f"{run}/store", f"{run}/figures")
    store.append_batch({"orders": part(1)}, f"{run}/store", "b")
    store.append_batch({"products": tables.products}, f"{run}/store", "d")
    incremental.refresh(spark, f"{run}/store", f"{run}/figures")
    return incremental.read_partials(spark, f"{run}/figures")


def _by_month(spark: SparkSession, folder: str, months: int) -> Tables:
    """The last months of a store by month that half the orders were written into, the other half a batch beside it."""
    tables = shop_tables(spark, folder)
    home = f"{checkpoint_folder(spark)}/months-{uuid.uuid4().hex}"
    ids = F.lit(0).cast("bigint")
    items = tables.order_items.select(ids.alias("order_item_id"), "*")
    for name, k in (("a", 0), ("b", 1)):
        half = F.pmod("order_id", F.lit(2)) == k
        store.append_batch({"orders": tables.orders.filter(half), "order_items": items.filter(half)}, home, name)
        if k == 0:
            store.write_by_month(spark, home, "1")
    store.append_batch({"products": tables.products, "categories": tables.categories}, home, "c")
    return store.read_months(spark, home, store.newest_months(spark, home, months))


def _twice(events: DataFrame) -> DataFrame:
    """Every event delivered twice."""
    return events.unionByName(events)


def _sales_deduped_stream(spark: SparkSession, folder: str) -> DataFrame:
    run = f"{checkpoint_folder(spark)}/deduped-{uuid.uuid4().hex}"
    events = _twice(realtime.read_events(spark, f"{folder}/events.parque[t]", event_schema()))
    realtime.write_daily_revenue(realtime.distinct_events(events), f"{run}/days", f"{run}/state").awaitTermination()
    return realtime.read_days(spark, f"{run}/days")


def _local(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "last_event")],
        "events", "purchases", "revenue")


def _sessions_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions that the stream has finished once it has seen every event, each delivered twice."""
    run = f"{checkpoint_folder(spark)}/sessions-{uuid.uuid4().hex}"
    events = _twice(realtime.read_events(spark, f"{folder}/events.parque[t]", event_schema()))
    realtime.write_sessions(realtime.user_sessions(events), f"{run}/sessions", f"{run}/state").awaitTermination()
    return _local(realtime.read_sessions(spark, f"{run}/sessions"))


def _sales_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event files run through the streaming job once; all its days.

    A stream reads a folder or a pattern, so the one file is named by a pattern.
    """
    run = f"{checkpoint_folder(spark)}/realtime-{uuid.uuid4().hex}"
    events = realtime.read_events(spark, f"{folder}/events.parque[t]", event_schema())
    realtime.write_daily_revenue(events, f"{run}/days", f"{run}/state").awaitTermination()
    return realtime.read_days(spark, f"{run}/days")


def queries() -> dict[str, Query]:
    over_shop: dict[str, Callable[[Tables], DataFrame]] = {
        # list views and lookups
        "customers_list": views.customers_list,
        "products_list": views.products_list,
        "orders_list": views.orders_list,
        "category_lookup": views.category_lookup,
        "customer_lookup": views.customer_lookup,
        "product_lookup": views.product_lookup,
        "order_lines": views.order_lines,
        "order_detail": views.order_detail,
        "order_payments": views.order_payments,
        "order_shipments": views.order_shipments,
        # headline figures
        "total_revenue": kpi.total_revenue,
        "total_orders": kpi.total_orders,
        "total_customers": kpi.total_customers,
        "total_products": kpi.total_products,
        "dashboard_kpis": kpi.dashboard_kpis,
        "average_order_value": kpi.average_order_value,
        # sales reports
        "top_products": sales.top_products,
        "category_revenue": sales.category_revenue,
        "monthly_revenue": sales.monthly_revenue,
        "top_customers": sales.top_customers,
        "city_revenue": sales.city_revenue,
        "payment_methods": sales.payment_methods,
        "payments_by_status": sales.payments_by_status,
        "low_stock": sales.low_stock,
        "product_ratings": sales.product_ratings,
        "product_performance": sales.product_performance,
        # customers
        "customer_profile": customers.customer_profile,
        "best_customer": customers.best_customer,
        "spending_stats": _spending_stats,
        "repeat_customers": customers.repeat_customers,
        "repeat_rate": customers.repeat_rate,
        "high_value_customers": customers.high_value_customers,
        # churn
        "churn_features": churn.churn_features,
        "churn_labels": churn.churn_labels,
        "churn_split_counts": churn.churn_split_counts,
        "churn_model_metrics": lambda tables: churn.train_and_test(tables)[1],
        "churn_scores": churn.churn_scores,
        "churn_model_top5": lambda tables: churn.top_risk(churn.churn_scores(tables)),
        "churn_boosted_metrics": lambda tables: churn.train_and_test(tables, "boosted")[1],
        "churn_fallback_risk": churn.fallback_risk,
        "churn_top5": lambda tables: churn.top_risk(churn.fallback_risk(tables)),
        "churn_label_90d": churn.churn_label_90d,
        "churn_90d_features": churn.churn_90d_features,
        "churn_90d_metrics": churn.churn_90d_metrics,
        "churn_90d_counts": lambda tables: churn.churn_90d_metrics(tables).select("train_rows", "test_rows"),
        "churn_metrics_summary": _metrics_summary("forest"),
        "churn_boosted_summary": _metrics_summary("boosted"),
        "churn_scores_summary": _churn_summary,
        # forecast
        "monthly_ordinal": forecast.monthly_ordinal,
        "forecast_fit": _forecast_fit,
        "forecast_next": forecast.forecast_next,
        "forecast_report": forecast.forecast_report,
        "forecast_by_category": forecast.forecast_by_category,
        # recommendations
        "top_spender": recommend.top_spender,
        "reco_siblings_top_spender": recommend.reco_siblings_top_spender,
        "reco_popular": recommend.reco_popular,
        "recommendations": recommend.recommendations,
        "reco_all_customers": recommend.reco_all_customers,
        "reco_with_fallback": recommend.reco_with_fallback,
        "reco_history_pairs": recommend.history_pairs,
        "reco_unseen": recommend.reco_unseen,
        # ingest
        "order_pricing": _order_pricing,
        "order_rejects": _order_rejects,
        "ingest_orders": _ingest_orders,
        "ingest_order_items": _ingest_order_items,
        "customer_rejects": _customer_rejects,
        "product_rejects": _product_rejects,
        "typed_rejects": _typed_rejects,
        "ingest_customers": _ingest_customers,
        "ingest_products": _ingest_products,
        "surrogate_keys": _surrogate_keys,
        "typed_orders": _typed_orders,
        "dedup_load": _dedup_load,
        "upsert_latest": _upsert_latest,
        # roadmap
        "rfm_scores": segments.rfm_scores,
        "customer_clusters": segments.customer_clusters,
        "monthly_trend": forecast.monthly_trend,
        "customer_clusters_summary": _segment_summary,
        "reco_als": segments.reco_als,
        "reco_als_summary": _als_summary,
        "inventory_alerts": segments.inventory_alerts,
        "reorder_points": segments.reorder_points,
        "cohort_retention": segments.cohort_retention,
        "churn_auc": judging.churn_auc,
        "churn_lift": judging.churn_lift,
        # price history
        "price_history": history.price_history,
        "price_history_merged": _price_history_merged,
        "order_price_asof": history.order_price_asof,
        "order_pricing_asof": _order_pricing_asof,
    }
    registered = {name: _over_shop(job) for name, job in over_shop.items()}
    registered["realtime_sales_batch"] = lambda spark, folder: realtime.daily_revenue(
        scan(prepare(spark), folder, "events"))
    registered["realtime_sales_stream"] = _sales_stream
    registered["realtime_sales_deduped"] = lambda spark, folder: realtime.daily_revenue(
        realtime.distinct_events(_twice(scan(prepare(spark), folder, "events"))))
    registered["realtime_sales_deduped_stream"] = _sales_deduped_stream
    registered["user_sessions"] = lambda spark, folder: _local(
        realtime.user_sessions(_twice(scan(prepare(spark), folder, "events"))))
    registered["user_sessions_stream"] = _sessions_stream
    registered["recent_monthly_revenue"] = lambda spark, folder: sales.monthly_revenue(_by_month(spark, folder, 6))
    registered["recent_category_revenue"] = lambda spark, folder: sales.category_revenue(_by_month(spark, folder, 6))
    registered["incremental_dashboard"] = lambda spark, folder: incremental.dashboard(_incremental(spark, folder))
    registered["incremental_monthly"] = lambda spark, folder: incremental.monthly(_incremental(spark, folder))
    return registered
