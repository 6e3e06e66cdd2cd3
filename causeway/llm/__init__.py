"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; the thin contract queries are in ``queries``.
"""
