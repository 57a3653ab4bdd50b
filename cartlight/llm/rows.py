"""Documents whose text changes while all other columns ride along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def others(documents: DataFrame) -> Column:
    """All columns but the text as one struct ``row``, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("row")


def restored(done: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns in their order again, from ``row`` and ``text`` (string or UTF-8 bytes), and ``more`` after them."""
    text = F.col("text").cast("string").alias("text")
    return done.select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in columns], *more)
