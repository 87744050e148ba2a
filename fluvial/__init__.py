"""Spark-native analytics for gauged and gridded time series on directed flow networks."""
