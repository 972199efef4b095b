"""Spark-native analytics for panel-scored events."""
