"""Operators of a training-data pipeline over large text tables.

Every operator is a function from DataFrames to a DataFrame and lives in its own module; ``queries`` registers
them over the given tables.  Nothing outside this package imports it.
"""
