"""Operators for preparing training text: deduplication, filtering, packing, scanning."""
