from datetime import date

import pytest
from pyspark.sql import functions as F

from cartlight import schemas
from cartlight.operators import ingest
from cartlight.sources import jdbc, store

CUSTOMER = ["arrival", "customer_name", "email", "phone", "city", "state", "country", "gender", "age"]


def forms(spark, columns, rows):
    kinds = ", ".join(f"{c} {'bigint' if c == 'arrival' else 'string'}" for c in columns)
    return spark.createDataFrame(rows, kinds)


def test_customers(spark, seed):
    batch = forms(spark, CUSTOMER, [
        (1, " Ann ", "a@x.org", None, " Pune ", None, "", "", " 31 "),
        (2, "Second Ann", "a@x.org", None, None, None, None, None, None),
        (3, "Old", "c3@example.com", None, None, None, None, None, None),
        (4, "  ", "b@x.org", None, None, None, None, None, None),
        (5, "No mail", None, None, None, None, None, None, None),
        (6, "Ben", " b@x.org", "1", "Goa", "Goa", "Nepal", "m", ""),
        (7, "Cal", "c@x.org", None, None, None, None, None, "old"),
    ])
    accepted, rejected = ingest.ingest_customers(batch, seed)
    rows = {r["email"]: r for r in accepted.collect()}
    assert set(rows) == {"a@x.org", "b@x.org"}
    ann, ben = rows["a@x.org"], rows["b@x.org"]
    assert (ann["customer_name"], ann["city"], ann["country"], ann["age"]) == ("Ann", "Pune", "India", 31)
    assert (ben["country"], ben["age"]) == ("Nepal", None)
    assert {ann["customer_id"], ben["customer_id"]} == {11, 12}
    assert ann["registration_date"] is not None
    assert {r["arrival"]: r["reject_reason"] for r in rejected.collect()} == {
        2: "email is taken", 3: "email is taken", 4: "name and email are required", 5: "name and email are required",
        7: "age is not a whole number"}
    assert accepted.count() + rejected.count() == batch.count()


def test_products(spark, seed):
    columns = ["product_name", "category_id", "price", "stock_quantity", "brand", "rating"]
    batch = forms(spark, columns, [
        (" Lamp ", "3", "99.5", "4", " Lux ", "4.1"),
        ("Bare", "1", "", None, None, " "),
        ("", "1", "1", "1", "", "1"),
        ("NoCategory", None, "1", "1", "", "1"),
        ("BadPrice", "1", "cheap", "1", "", "1"),
        ("BadStock", "1", "1", "1.5", "", "1"),
    ])
    accepted, rejected = ingest.ingest_products(batch, seed)
    rows = {r["product_name"]: r for r in accepted.collect()}
    assert set(rows) == {"Lamp", "Bare"}
    assert (rows["Lamp"]["price"], rows["Lamp"]["stock_quantity"], rows["Lamp"]["brand"]) == (99.5, 4, "Lux")
    assert (rows["Bare"]["price"], rows["Bare"]["stock_quantity"], rows["Bare"]["rating"]) == (0.0, 0, 0.0)
    assert {r["product_id"] for r in rows.values()} == {15, 16}
    assert sorted(r["reject_reason"] for r in rejected.collect()) == [
        "name and category are required", "name and category are required",
        "price is not a number", "stock_quantity is not a whole number"]


ORDER = ["customer_id", "product_id", "quantity", "order_status", "order_date"]


def test_orders(spark, seed):
    batch = forms(spark, ORDER, [
        ("1", "3", "2", None, "2025-06-01"),
        ("1", "1", "1", "Shipped", ""),
        ("77", "4", " 3 ", "", "2025-06-02"),
        ("1", "1", "x", None, None),
        ("1", "1", "0", None, None),
        ("1", "1", "-1", None, None),
        ("1", "1", None, None, None),
        (None, "1", "1", None, None),
        ("1", "", "1", None, None),
        ("1", "999", "1", None, None),
        ("1", "1", "1", None, "soon"),
    ])
    orders, items, rejected = ingest.ingest_orders(batch, seed)
    by_day = {r["order_date"]: r for r in orders.collect()}
    assert len(by_day) == 3
    first = by_day[date(2025, 6, 1)]
    assert (first["customer_id"], first["order_status"], first["total_amount"]) == (1, "Pending", 2400.0)
    assert by_day[date(2025, 6, 2)]["order_status"] == ""
    assert sorted(r["order_id"] for r in by_day.values()) == [11, 12, 13]
    lines = {r["order_id"]: r for r in items.collect()}
    assert (lines[first["order_id"]]["quantity"], lines[first["order_id"]]["unit_price"]) == (2, 1200.0)
    assert sorted(r["order_item_id"] for r in lines.values()) == [17, 18, 19]
    reasons = [r["reject_reason"] for r in rejected.collect()]
    assert len(reasons) == 8 and reasons.count("product not found") == 1 and reasons.count("order_date is not a date") == 1
    strict, _, more = ingest.ingest_orders(batch, seed, strict_customers=True)
    assert strict.count() == 2
    assert "customer not found" in {r["reject_reason"] for r in more.collect()}


def test_ids_stay_when_the_tables_grow(spark, seed):
    """Live catalogue tables: what is appended meanwhile does not move ids already given."""
    spark.sql("create database if not exists live_shop")
    try:
        for name in ("orders", "order_items"):
            getattr(seed, name).write.mode("overwrite").saveAsTable(f"live_shop.{name}")
        live = seed.replace(orders=spark.table("live_shop.orders"), order_items=spark.table("live_shop.order_items"))
        batch = forms(spark, ORDER, [("1", "3", "2", None, "2025-06-01"), ("2", "4", "1", None, "2025-06-02")])
        orders, items, _ = ingest.ingest_orders(batch, live)
        orders.write.mode("append").saveAsTable("live_shop.orders")
        items.select(*seed.order_items.columns).write.mode("append").saveAsTable("live_shop.order_items")
        lines = spark.table("live_shop.order_items").join(spark.table("live_shop.orders"), "order_id").filter("order_id > 10")
        assert sorted((r["order_id"], r["order_item_id"]) for r in lines.collect()) == [(11, 17), (12, 18)]
        assert all(r["quantity"] * r["unit_price"] == r["total_amount"] for r in lines.collect())
    finally:
        spark.sql("drop database live_shop cascade")


def test_a_failed_batch_can_be_repeated(spark, seed, tmp_path, monkeypatch):
    folder = str(tmp_path)
    for name in ("orders", "order_items", "products"):
        store.append(getattr(seed, name), folder, name)
    batch = forms(spark, ORDER, [("1", "3", "2", None, "2025-06-01"), ("2", "4", "1", None, "2025-06-02")])

    def load():
        orders, items, _ = ingest.ingest_orders(batch, store.read_store(spark, folder))
        return store.append_batch({"orders": orders, "order_items": items}, folder, "2025-06-02")

    def counts():
        now = store.read_store(spark, folder)
        return now.orders.count(), now.order_items.count()

    with monkeypatch.context() as patch:
        patch.setattr(store, "mark_whole", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            load()
    assert counts() == (10, 16)
    assert load() is True and counts() == (12, 18)
    assert load() is False and counts() == (12, 18)
    now = store.read_store(spark, folder)
    lines = now.order_items.join(now.orders, "order_id").filter("order_id > 10").collect()
    assert len(lines) == 2 and all(r["quantity"] * r["unit_price"] == r["total_amount"] for r in lines)


def test_an_upsert_is_stored_and_read_back(spark, seed, tmp_path):
    folder = str(tmp_path)
    store.append(seed.products, folder, "products")
    new = seed.products.filter("product_id = 1").withColumn("product_id", F.lit(15).cast("bigint"))
    store.append_batch({"products": new}, folder, "b1")
    now = store.read_store(spark, folder).products
    changes = now.filter("product_id in (2, 3)").withColumn("price", F.lit(1.0)).withColumn("version", F.lit(1)).withColumn(
        "gone", F.col("product_id") == 3)
    store.write_snapshot(ingest.upsert_by_key(now, changes, ["product_id"], "version", "gone"), folder, "products", "v1")
    after = {r["product_id"]: r["price"] for r in store.read_store(spark, folder).products.collect()}
    assert len(after) == 14 and after[2] == 1.0 and 3 not in after and after[15] == 65000.0
    store.append_batch({"products": new.withColumn("product_id", F.lit(16).cast("bigint"))}, folder, "b2")
    assert store.read_store(spark, folder).products.count() == 15


def test_the_first_row_wins_in_any_order(spark):
    rows = [(1, "a", 2), (1, "b", 1), (1, "c", 1), (2, None, 1), (None, "d", 1), (None, "e", 2)]
    none = spark.createDataFrame([], "k bigint")
    for batch in (rows, rows[::-1], rows[3:] + rows[:3]):
        frame = spark.createDataFrame(batch, "k bigint, x string, arrival int").repartition(3)
        got = {(r["k"], r["x"]) for r in ingest.new_rows(frame, none, ["k"], ["arrival"]).collect()}
        assert got == {(1, "b"), (2, None), (None, "d")}


def test_equal_versions_have_one_winner(spark):
    current = spark.createDataFrame([(1, "old")], "k bigint, x string")
    for rows in ([(1, "p", 3), (1, "q", 3)], [(1, "q", 3), (1, "p", 3)]):
        changes = spark.createDataFrame(rows, "k bigint, x string, v int").repartition(2)
        assert [tuple(r) for r in ingest.upsert_by_key(current, changes, ["k"], "v").collect()] == [(1, "p")]


def test_loading_twice_changes_nothing(seed):
    keys = schemas.NATURAL_KEYS["products"]
    fresh = ingest.new_rows(seed.products.unionByName(seed.products), seed.products.limit(0), keys)
    assert fresh.count() == 14
    assert ingest.new_rows(seed.products, seed.products, keys).count() == 0


def test_checked_orders_are_stored(spark, seed, tmp_path):
    folder = str(tmp_path)
    for name in ("orders", "order_items"):
        store.append(getattr(seed, name), folder, name)
    batch = forms(spark, ORDER, [("1", "3", "2", None, "2025-06-01"), ("2", "999", "1", None, None)])
    orders, items, rejected = ingest.ingest_orders(batch, seed)
    store.append(orders, folder, "orders")
    store.append(items, folder, "order_items")
    stored = store.read_store(spark, folder)
    line = stored.order_items.join(stored.orders, "order_id").filter("order_date = '2025-06-01'").collect()
    assert [(r["product_id"], r["quantity"], r["total_amount"]) for r in line] == [(3, 2, 2400.0)]
    assert (stored.orders.count(), stored.order_items.count(), rejected.count()) == (11, 17, 1)


def test_upsert(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k bigint, x string")
    changes = spark.createDataFrame(
        [(2, "old", 1, False), (2, "new", 2, False), (3, "c", 5, True), (4, "d", 1, False)],
        "k bigint, x string, version int, gone boolean")
    got = ingest.upsert_by_key(current, changes, ["k"], "version", "gone").collect()
    assert sorted(tuple(r) for r in got) == [(1, "a"), (2, "new"), (4, "d")]
    kept = ingest.upsert_by_key(current, changes, ["k"], "version").collect()
    assert sorted(tuple(r) for r in kept) == [(1, "a"), (2, "new"), (3, "c"), (4, "d")]


def test_store_round_trip(spark, seed, tmp_path):
    folder = str(tmp_path)
    for name in seed.names():
        store.append(getattr(seed, name), folder, name)
    stored = store.read_store(spark, folder)
    for name in seed.names():
        assert sorted(map(str, getattr(stored, name).collect())) == sorted(map(str, getattr(seed, name).collect()))
    store.append(seed.orders, folder, "orders")
    assert store.read_store(spark, folder).orders.count() == 20


def test_append_refuses_missing_values(spark, tmp_path):
    bad = spark.createDataFrame([(1, None, None)], "category_id bigint, category_name string, description string")
    with pytest.raises(Exception, match="must not be null"):
        store.append(bad, str(tmp_path), "categories")


def test_bucketed_join_needs_no_shuffle(spark, seed):
    spark.sql("create database if not exists bucketed_shop")
    store.write_bucketed(seed, "bucketed_shop", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed = store.read_bucketed(spark, "bucketed_shop", seed)
        orders, items = bucketed.orders, bucketed.order_items
        plan = items.join(orders.select("order_id"), "order_id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop database bucketed_shop cascade")


def test_csv_batch(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(
        "order_id,customer_id,order_date,order_status,total_amount\n"
        "1,1,2025-05-01,Delivered,66200\n2,x,2025-05-01,Delivered,1\n,1,2025-05-01,Delivered,1\n3,1,,,\n4,1,May,,1\n")
    good, bad = store.typed(store.read_csv_batch(spark, str(path), "orders"), "orders")
    assert [tuple(r) for r in good.orderBy("order_id").collect()] == [
        (1, 1, date(2025, 5, 1), "Delivered", 66200.0), (3, 1, None, None, None)]
    assert sorted(r["reject_reason"] for r in bad.collect()) == [
        "customer_id is not a bigint", "order_date is not a date", "order_id is missing"]
    assert dict(good.dtypes) == {f.name: f.dataType.simpleString() for f in schemas.schema("orders").fields}


def test_sql_with_parameters(spark, seed):
    df = store.run_sql(spark, seed, "select count(*) n from orders where customer_id = :cid", {"cid": 6})
    assert df.first()["n"] == 1


def test_jdbc_options():
    options = jdbc.scan_options("orders", 1, 1000, 16, env={"MYSQL_HOST": "db", "MYSQL_PORT": "3307"})
    assert options["url"] == "jdbc:mysql://db:3307/shop"
    assert (options["partitionColumn"], options["numPartitions"], options["upperBound"]) == ("order_id", "16", "1000")
    with pytest.raises(ValueError):
        jdbc.scan_options("admins", 1, 2, 3)
