"""Spark-native operators for event calendars, entry thresholds and training-data preparation."""
