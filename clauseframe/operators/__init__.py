"""Operators over DataFrames: joins, windows, aggregates, ranking, repository tables."""
