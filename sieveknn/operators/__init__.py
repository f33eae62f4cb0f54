"""Filters, exact and approximate nearest neighbours."""
