"""Spark-native text-classification analytics.

Operators take DataFrames and return DataFrames; every row identity is an
explicit key column, because Spark tables have no row order.
"""
