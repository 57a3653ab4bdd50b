"""Revenue forecast: least squares over numbered months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cartlight.functions.money import micros_sum, money, money_sum
from cartlight.functions.parsing import month_label
from cartlight.operators.common import CANCELLED, kept_orders
from cartlight.tables import Tables

MODEL_COLUMNS = "slope double, intercept double, months bigint"


def monthly_ordinal(
    tables: Tables, fill_gaps: bool = False, exclude_status: str | None = CANCELLED
) -> DataFrame:
    """month, month_number (1..n in calendar order), revenue. Orders without a date are left out.

    Months without sales are skipped, or filled with 0 with ``fill_gaps``. The unpartitioned window
    runs on one row per calendar month.
    """
    first_day = F.trunc("order_date", "month")
    months = (
        kept_orders(tables, exclude_status).filter("order_date is not null")
        .groupBy(first_day.alias("first_day"))
        .agg(money_sum(F.col("total_amount")).alias("revenue"))
    )
    if fill_gaps:
        span = months.agg(F.min("first_day").alias("lo"), F.max("first_day").alias("hi")).filter("lo is not null")
        calendar = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("first_day"))
        months = calendar.join(months, "first_day", "left").withColumn(
            "revenue", F.coalesce("revenue", F.lit(0.0))
        )
    number = F.row_number().over(Window.orderBy("first_day")).cast("bigint")
    return months.select(
        month_label(F.col("first_day")).alias("month"), number.alias("month_number"), "revenue"
    )


def _fit_columns() -> tuple[Column, Column, Column]:
    """Slope 0 (and so the mean as intercept) where one month gives no line."""
    x, y = F.col("month_number"), F.col("revenue")
    slope = F.coalesce(F.regr_slope(y, x), F.when(F.count(y) > 0, F.lit(0.0)))
    intercept = F.avg(y) - slope * F.avg(F.when(y.isNotNull(), x))
    return slope.alias("slope"), intercept.alias("intercept"), F.count(F.lit(1)).alias("months")


def fit_line(history: DataFrame, *keys: str) -> DataFrame:
    """slope, intercept, months of revenue over month_number, per ``keys`` if given."""
    return history.groupBy(*keys).agg(*_fit_columns())


def predict(fit: DataFrame, month_number: Column | None = None) -> DataFrame:
    """next_month_number and predicted_revenue (2 decimals) from coefficient rows.

    ``month_number`` overrides the number that follows the fitted months.
    """
    number = F.col("months") + 1 if month_number is None else month_number
    keys = [c for c in fit.columns if c not in ("slope", "intercept", "months")]
    return fit.withColumn("next_month_number", number.cast("bigint")).select(
        *keys, "next_month_number",
        F.round(F.col("intercept") + F.col("slope") * F.col("next_month_number"), 2).alias("predicted_revenue"),
    )


def forecast_next(tables: Tables, fill_gaps: bool = False) -> DataFrame:
    return predict(fit_line(monthly_ordinal(tables, fill_gaps)))


def fit_forecast(tables: Tables, fill_gaps: bool = False) -> DataFrame:
    """The coefficient row for saving. Raises ValueError when there are no sales."""
    fit = fit_line(monthly_ordinal(tables, fill_gaps))
    row = fit.first()
    if row["months"] == 0:
        raise ValueError("no sales to fit")
    return fit.sparkSession.createDataFrame([tuple(row)], MODEL_COLUMNS)


def forecast_with(coefficients: DataFrame, tables: Tables, fill_gaps: bool = False) -> DataFrame:
    """Apply saved coefficients to the month after today's history, however old the fit is."""
    months_now = monthly_ordinal(tables, fill_gaps).agg(F.count(F.lit(1)).alias("n")).scalar()
    return predict(coefficients, months_now + 1)


def forecast_report(tables: Tables, fill_gaps: bool = False) -> DataFrame:
    """The month history, each row with the number and forecast of the month that follows."""
    history = monthly_ordinal(tables, fill_gaps)
    outlook = forecast_next(tables, fill_gaps).select(F.struct("next_month_number", "predicted_revenue")).scalar()
    return (
        history.withColumn("outlook", outlook)
        .select("month", "revenue", "outlook.next_month_number", "outlook.predicted_revenue")
        .orderBy("month")
    )


def forecast_by_category(tables: Tables, exclude_status: str | None = CANCELLED) -> DataFrame:
    """The same forecast per category, from item revenue (an addition to the shop-wide one).

    Reduced to (product, month) and then (category, month) before the names are joined; the window
    and the fit see one row per category and month.
    """
    dated = kept_orders(tables, exclude_status).filter("order_date is not null").select(
        "order_id", F.trunc("order_date", "month").alias("first_day")
    )
    by_product = (
        tables.order_items.select("order_id", "product_id", "quantity", "unit_price")
        .join(dated, "order_id")
        .groupBy("product_id", "first_day")
        .agg(micros_sum(F.col("quantity") * F.col("unit_price")).alias("sold_micros"))
    )
    by_category = (
        by_product.join(tables.products.select("product_id", "category_id"), "product_id")
        .groupBy("category_id", "first_day").agg(money(F.sum("sold_micros")).alias("revenue"))
    )
    numbered = by_category.withColumn(
        "month_number",
        F.row_number().over(Window.partitionBy("category_id").orderBy("first_day")).cast("bigint"),
    )
    names = tables.categories.select("category_id", "category_name")
    return (
        predict(fit_line(numbered, "category_id"))
        .join(names, "category_id")
        .select("category_id", "category_name", "next_month_number", "predicted_revenue")
        .orderBy("category_id")
    )


def monthly_trend(tables: Tables, window: int = 3) -> DataFrame:
    """Gap-free months with the change to the month before and a moving average."""
    order = Window.orderBy("month_number")
    recent = order.rowsBetween(1 - window, 0)
    return monthly_ordinal(tables, fill_gaps=True).select(
        "month", "month_number", "revenue",
        (F.col("revenue") - F.lag("revenue").over(order)).alias("change"),
        F.avg("revenue").over(recent).alias("moving_average"),
    ).orderBy("month_number")


def save_coefficients(fit: DataFrame, path: str) -> None:
    fit.coalesce(1).write.mode("overwrite").parquet(path)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_COLUMNS).parquet(path)
