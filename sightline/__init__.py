"""Visibility-graph analytics over large collections of time series, on Spark.

Every operator maps DataFrames to DataFrames and is keyed by ``series_id``, so
one plan covers any number of series.
"""

__version__ = "0.1.0"
