"""Spark-native analytics over code and document corpora."""
