"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each operator module has one public
entry function that maps DataFrames to DataFrames, and ``queries`` binds the
operators to the driver's tables.
"""
