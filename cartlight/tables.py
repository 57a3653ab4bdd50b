"""The bundle of shop tables that every job takes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

TABLE_NAMES = (
    "customers", "categories", "products", "orders", "order_items", "payments", "shipping", "reviews",
)


class Tables:
    """Named DataFrames, each built only when a job first asks for it.

    Entries may be DataFrames or zero-argument callables returning one.
    """

    def __init__(self, entries: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._entries = dict(entries)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._entries:
            raise AttributeError(name)
        entry = self._entries[name]
        if not isinstance(entry, DataFrame):
            entry = self._entries[name] = entry()
        return entry

    def names(self) -> list[str]:
        return list(self._entries)

    def replace(self, **frames: DataFrame) -> Tables:
        """A copy with some tables swapped."""
        return Tables({**self._entries, **frames})
