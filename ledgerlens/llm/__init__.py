"""Operators of a training-data pipeline, one module for each.

Nothing else in the library imports this package; it uses the library's general
helpers (scratch tables, running sums).  ``queries.py`` registers one query for
each operator.
"""
