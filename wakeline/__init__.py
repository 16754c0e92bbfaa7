"""Spark-native analytics for track data and training corpora."""
