"""Spark-native analytics for labelled, multi-channel time series."""
