"""Operators for preparing training data: deduplication, filtering, mixing, packing and search.

Nothing else in the library imports this package. Each module has one operator on
DataFrames; ``queries`` applies each of them to its whole table.
"""
