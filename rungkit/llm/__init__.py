"""Operators of a training-data pipeline over text and embedding tables.

Nothing outside this package imports it; ``__spark_entry__`` adds its
queries when the package is present.  Every operator takes DataFrames plus
column names, selects only the columns it needs (so further columns of any
name are harmless) and returns a DataFrame.
"""
