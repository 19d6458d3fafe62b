"""Spark-native corpus curation, dataset building and evaluation analytics."""
