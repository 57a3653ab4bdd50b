"""Typed values out of form text, NULL where the text does not fit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def iso_date(text: Column) -> Column:
    """A date from text that starts with yyyy-MM-dd, such as '2025-06-01 10:00'."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def whole_number(text: Column) -> Column:
    """A whole number with optional sign and spaces around it; '5.0' and 'x' are not whole numbers."""
    return text.try_cast("bigint")


def number(text: Column) -> Column:
    return text.try_cast("double")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
