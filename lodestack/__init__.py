"""Spark-native engine for dataset catalogues; see README.md."""
