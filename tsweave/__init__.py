"""Spark-first analytics for time series of prices, with a subpackage for training-data pipelines."""
