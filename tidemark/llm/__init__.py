"""Operators for preparing language-model training data.

Every operator is a function from DataFrames to DataFrames.  Nothing outside
this subpackage imports it, so it can be removed without touching the rest of
the library.
"""
