"""Spark-native analytics for multi-channel time-ordered sensor data."""
