"""Saved models: fitted once, loaded afterwards."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from cartlight.operators import forecast
from cartlight.operators.churn import ChurnModel, train_and_test
from cartlight.sources import store
from cartlight.tables import Tables


def _save(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write a model to a new folder in ``path`` and mark it whole last: a crash leaves the model before it in use."""
    home = f"{path}/{time.time_ns():020d}"
    write(home)
    store.mark_whole(spark, home)


def _newest(spark: SparkSession, path: str) -> str | None:
    whole = store.whole_folders(spark, path)
    return whole[-1] if whole else None


def save_churn(model: ChurnModel, path: str) -> None:
    spark = SparkSession.active()

    def write(home: str) -> None:
        model.pipeline.write().save(f"{home}/pipeline")
        rows = [(int(label),) for label in model.labels]
        spark.createDataFrame(rows, "label int").coalesce(1).write.parquet(f"{home}/labels")

    _save(spark, path, write)


def load_churn(spark: SparkSession, path: str) -> ChurnModel | None:
    """The newest whole model in ``path``, None if there is none."""
    home = _newest(spark, path)
    if home is None:
        return None
    rows = spark.read.schema("label int").parquet(f"{home}/labels").orderBy("label").collect()  # at most two labels
    return ChurnModel(PipelineModel.load(f"{home}/pipeline"), [row["label"] for row in rows])


def load_or_fit_churn(spark: SparkSession, tables: Tables, path: str, refit: bool = False) -> ChurnModel:
    """The saved model; fitted and saved if there is no whole one, or if ``refit`` asks for a new one."""
    model = None if refit else load_churn(spark, path)
    if model is None:
        model, _ = train_and_test(tables)
        save_churn(model, path)
    return model


def load_or_fit_forecast(spark: SparkSession, tables: Tables, path: str, refit: bool = False) -> DataFrame:
    if refit or _newest(spark, path) is None:
        fit = forecast.fit_forecast(tables)
        _save(spark, path, lambda home: forecast.save_coefficients(fit, f"{home}/line"))
    return forecast.load_coefficients(spark, f"{_newest(spark, path)}/line")


def retrain(spark: SparkSession, tables: Tables, folder: str) -> tuple[ChurnModel, DataFrame]:
    """Fit both models anew and replace the saved ones."""
    churn = load_or_fit_churn(spark, tables, f"{folder}/churn", refit=True)
    line = load_or_fit_forecast(spark, tables, f"{folder}/forecast", refit=True)
    return churn, line
