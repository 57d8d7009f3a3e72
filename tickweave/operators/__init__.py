"""Operators: joins, windows, aggregates, splits, gates."""
