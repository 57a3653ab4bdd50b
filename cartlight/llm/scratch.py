"""Tables written once to the shared checkpoint folder, and session settings of the text operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from cartlight.session import checkpoint_folder, prepare

# Rows per Arrow batch: texts are long, so batches are kept short. Shuffle files go when their query has ended.
_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session's context, so that they need no search path."""
    context = spark.sparkContext
    if not getattr(context, "_cartlight_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = tempfile.mkdtemp(prefix="cartlight-code-")  # the driver serves the archive from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{folder}/cartlight-code", "zip", top, "cartlight"))
        context._cartlight_shipped = True


class Scratch:
    """Parquet tables of one job in ``spark.checkpoint.dir``: lineage ends there, and a lost executor loses nothing.

    ``drop`` removes a table as soon as no later step reads it; tables that the returned frame reads stay.
    """

    def __init__(self, spark: SparkSession, job: str):
        prepare(spark)
        ship(spark)
        for key, value in _SETTINGS.items():
            spark.conf.set(key, value)
        self.spark = spark
        self._folder = f"{checkpoint_folder(spark)}/{job}-{uuid.uuid4().hex}"
        self._count = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._count += 1
        path = f"{self._folder}/{self._count:03d}-{name}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
