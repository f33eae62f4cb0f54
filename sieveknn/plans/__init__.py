"""Strategies that combine filters and vector search, indexes, and their evaluation."""
