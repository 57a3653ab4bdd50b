"""The shop tables at rest: Parquet folders, CSV batches, named views."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cartlight import schemas
from cartlight.functions.parsing import blank_to_null, iso_date
from cartlight.session import prepare
from cartlight.tables import TABLE_NAMES, Tables

_REJECT = "reject_reason"
_WHOLE, _BATCHES, _VERSIONS = "_WHOLE", "_batches", "_versions"
# Tables that can lie in folders by month, the partition column, and files per month that their rows are dealt into.
BY_MONTH, MONTH, _FILES = ("orders", "order_items"), "month", 8


def read_store(spark: SparkSession, folder: str) -> Tables:
    """Scan the eight tables from ``folder/<table>``, their newest version and the whole batches, with fixed schemas."""
    prepare(spark)
    return Tables({name: (lambda name=name: _read(spark, folder, name)) for name in TABLE_NAMES})


def _sources(spark: SparkSession, folder: str, name: str, batches: list[str] | None = None) -> tuple[str | None, list[str]]:
    """The folder of a table's newest version, or its first one, if there is any; and those of the batches it lacks."""
    versions = whole_folders(spark, f"{folder}/{_VERSIONS}/{name}")
    held: set[str] = set()
    first = f"{folder}/{name}"
    if versions:
        first = f"{versions[-1]}/rows"
        rows = spark.read.schema("batch string").parquet(f"{versions[-1]}/batches").collect()  # a row per batch held
        held = {row["batch"] for row in rows}
    if batches is None:
        batches = whole_batches(spark, folder)
    more = [f"{b}/{name}" for b in batches if b.rsplit("/", 1)[1] not in held and has_folder(spark, f"{b}/{name}")]
    return first if has_folder(spark, first) or not more else None, more


def _read(spark: SparkSession, folder: str, name: str, batches: list[str] | None = None) -> DataFrame:
    """All rows of a table; of a version by month without that column."""
    scan = spark.read.schema(schemas.schema(name))
    first, more = _sources(spark, folder, name, batches)
    if first is None:
        return scan.parquet(*more)
    rows = scan.parquet(first).select(*schemas.schema(name).fieldNames())
    return rows.unionByName(scan.parquet(*more)) if more else rows


def append(df: DataFrame, folder: str, table: str) -> None:
    """Append rows with exactly the table's columns and types; nothing is written if a value does not fit."""
    _checked(df, table).write.mode("append").parquet(f"{folder}/{table}")


def _checked(df: DataFrame, table: str) -> DataFrame:
    wanted = schemas.schema(table)
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])
    required = [f.name for f in wanted.fields if not f.nullable]
    return typed.select(*[
        F.when(F.col(name).isNotNull(), F.col(name))
        .otherwise(F.raise_error(F.lit(f"{table}.{name} must not be null"))).alias(name)
        if name in required else F.col(name)
        for name in typed.columns
    ])


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def mark_whole(spark: SparkSession, folder: str) -> None:
    """Say, by an empty file written last, that everything in ``folder`` has been written."""
    files, place = _filesystem(spark, f"{folder}/{_WHOLE}")
    files.create(place, True).close()


def is_whole(spark: SparkSession, folder: str) -> bool:
    files, place = _filesystem(spark, f"{folder}/{_WHOLE}")
    return files.exists(place)


def whole_folders(spark: SparkSession, folder: str) -> list[str]:
    """The marked folders in ``folder``, by name."""
    files, pattern = _filesystem(spark, f"{folder}/*/{_WHOLE}")
    found = files.globStatus(pattern) or []
    return sorted(str(status.getPath().getParent().toString()) for status in found)


def whole_batches(spark: SparkSession, folder: str) -> list[str]:
    """The folders of the batches of a store that are whole, by name."""
    return whole_folders(spark, f"{folder}/{_BATCHES}")


def has_folder(spark: SparkSession, path: str) -> bool:
    files, place = _filesystem(spark, path)
    return files.exists(place)


def append_batch(frames: dict[str, DataFrame], folder: str, batch_id: str) -> bool:
    """Append rows to several tables as one: readers see all of them or none. Says whether anything was written.

    The rows go to a folder of the batch that ``read_store`` only reads once its marker, written last, is there. A
    batch that failed can be run again under its id; one that is stored already is left alone.
    """
    spark = next(iter(frames.values())).sparkSession
    home = f"{folder}/{_BATCHES}/{batch_id}"
    if is_whole(spark, home):
        return False
    for table, df in frames.items():
        _checked(df, table).write.mode("overwrite").parquet(f"{home}/{table}")
    mark_whole(spark, home)
    return True


def write_snapshot(df: DataFrame, folder: str, table: str, version: str) -> None:
    """Replace a table by a new version beside the old ones, so that it can be made from the table itself.

    The newest marked version, by name, is what ``read_store`` reads instead of the table's first folder. Batches
    that the version already holds are listed in it and no longer added.
    """
    spark = df.sparkSession
    home = f"{folder}/{_VERSIONS}/{table}/{version}"
    held = whole_folders(spark, f"{folder}/{_BATCHES}")
    _checked(df, table).write.mode("overwrite").parquet(f"{home}/rows")
    names = [(b.rsplit("/", 1)[1],) for b in held]
    spark.createDataFrame(names, "batch string").coalesce(1).write.mode("overwrite").parquet(f"{home}/batches")
    mark_whole(spark, home)


def write_by_month(spark: SparkSession, folder: str, version: str) -> None:
    """Put orders and order items at rest in a folder per month of the order, as the next version of both tables.

    Everything that is whole now goes into it, so that many small batch folders become few files a month; batches that
    come meanwhile stay beside it. Orders without a date, and items without an order, lie in the month "none". A
    month's rows are dealt into several files, so a hot month is not written by one task. Readers take a table's newest
    version once its marker is there; items are marked after orders, and both hold the same rows whichever is read.
    """
    batches = whole_batches(spark, folder)
    month = F.coalesce(F.date_format("order_date", "yyyy-MM"), F.lit("none")).alias(MONTH)
    orders = _read(spark, folder, "orders", batches).select("*", month)
    items = _read(spark, folder, "order_items", batches).join(orders.select("order_id", MONTH), "order_id", "left")
    items = items.withColumn(MONTH, F.coalesce(MONTH, F.lit("none")))
    names = spark.createDataFrame([(b.rsplit("/", 1)[1],) for b in batches], "batch string")
    for name, frame in (("orders", orders), ("order_items", items)):
        home = f"{folder}/{_VERSIONS}/{name}/{version}"
        dealt = frame.select(*schemas.schema(name).fieldNames(), MONTH).repartition(
            F.col(MONTH), F.pmod(F.xxhash64("order_id"), F.lit(_FILES)))
        dealt.write.mode("overwrite").partitionBy(MONTH).parquet(f"{home}/rows")
        names.coalesce(1).write.mode("overwrite").parquet(f"{home}/batches")
        mark_whole(spark, home)


def read_months(spark: SparkSession, folder: str, first: str | Column, last: str | Column | None = None) -> Tables:
    """The store with the orders of some months ("2025-01", both included) and their items alone.

    Of tables by month only those months' folders are read, also where ``first`` is a scalar subquery, which is worked
    out before the scan (``newest_months``). Rows of batches beside them are filtered by their date. Items of batches are
    all kept: which month they belong to is up to their orders, that every job joins them with.
    """
    first = F.lit(first) if isinstance(first, str) else first
    last = F.lit("9999-12") if last is None else F.lit(last) if isinstance(last, str) else last

    def some(name: str) -> DataFrame:
        scan = spark.read.schema(schemas.schema(name))
        place, more = _sources(spark, folder, name)
        parts = []
        for path in ([place] if place else []) + more:
            rows = scan.parquet(path)
            if MONTH in rows.columns:
                rows = rows.filter((F.col(MONTH) >= first) & (F.col(MONTH) <= last) & (F.col(MONTH) != "none"))
            elif name == "orders":
                rows = rows.filter(F.date_format("order_date", "yyyy-MM").between(first, last))
            parts.append(rows.select(*schemas.schema(name).fieldNames()))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    return read_store(spark, folder).replace(**{name: some(name) for name in BY_MONTH})


def newest_months(spark: SparkSession, folder: str, n: int) -> Column:
    """The first of the last ``n`` months up to that of the newest order, as a subquery of whatever uses it."""
    newest = F.max("order_date")
    return read_store(spark, folder).orders.agg(F.date_format(F.add_months(newest, 1 - n), "yyyy-MM")).scalar()


def read_bucketed(spark: SparkSession, database: str, tables: Tables) -> Tables:
    """``tables`` with orders and order items read from the bucketed copies, whose join needs no shuffle."""
    return tables.replace(
        orders=spark.table(f"{database}.orders"), order_items=spark.table(f"{database}.order_items")
    )


def write_bucketed(tables: Tables, database: str, buckets: int) -> None:
    """Save the two big tables bucketed and sorted by order_id, so that joining them needs no shuffle."""
    for name in ("orders", "order_items"):
        frame = getattr(tables, name)
        (
            frame.write.mode("overwrite").format("parquet")
            .bucketBy(buckets, "order_id").sortBy("order_id")
            .saveAsTable(f"{database}.{name}")
        )


def read_csv_batch(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a CSV batch (with header) as text columns, untyped so that bad values can be reported."""
    return spark.read.schema(schemas.as_text(table)).option("header", True).csv(path)


def typed(raw: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split text rows into typed rows and rejects with a reason.

    A blank value is NULL. A value that does not parse, or a missing required one, rejects its row.
    """
    fields = schemas.schema(table).fields
    problems = []
    columns = []
    for field in fields:
        text = blank_to_null(F.col(field.name))
        kind = field.dataType.simpleString()
        if kind == "string":
            value = text
        elif kind == "date":
            value = iso_date(text)
        else:
            value = text.try_cast(field.dataType)
        problems.append(F.when(text.isNotNull() & value.isNull(), F.lit(f"{field.name} is not a {kind}")))
        if not field.nullable:
            problems.append(F.when(text.isNull(), F.lit(f"{field.name} is missing")))
        columns.append(value.alias(field.name))
    reason = F.concat_ws("; ", *problems)
    judged = raw.withColumn(_REJECT, reason)
    good = judged.filter(F.col(_REJECT) == "").select(*columns)
    return good, judged.filter(F.col(_REJECT) != "")


def run_sql(spark: SparkSession, tables: Tables, text: str, args: dict[str, Any] | None = None) -> DataFrame:
    """Run SQL over the shop tables, with ``:name`` parameters bound from ``args``."""
    for name in tables.names():
        getattr(tables, name).createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})
