"""Operators of a training-data pipeline over a table of documents.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin queries over the standard tables are in ``queries``.
"""
