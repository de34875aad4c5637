"""Operators for preparing training corpora, each a DataFrame -> DataFrame function."""
