"""Retail analytics as Spark DataFrame jobs.

Every job takes a :class:`~cartlight.tables.Tables` bundle (customers, categories, products, orders,
order_items, payments, shipping, reviews) and returns a lazy DataFrame.
"""

from cartlight.tables import Tables

__all__ = ["Tables"]
