"""Spark-native analytics for features that exist only for part of history."""
