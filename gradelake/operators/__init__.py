"""Joins, aggregates, windows, set operations and scorers over DataFrames."""
