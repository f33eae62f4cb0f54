"""Hybrid search on Spark: nearest vectors among the rows that satisfy a structured filter."""

__version__ = "0.1.0"
