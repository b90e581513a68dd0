"""Spark-native time-series anomaly analytics."""
