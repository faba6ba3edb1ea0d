"""Gridded time series as Spark DataFrames: exact differencing, distributions and codecs.

A grid is a DataFrame of cells (t, y, x, v): time, row, column and a float32
value, dense and 0-based.  Every operator is a DataFrame transformation.
"""
