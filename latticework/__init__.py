"""Spark-native analytics for periodic crystal graphs and training-data tables."""
