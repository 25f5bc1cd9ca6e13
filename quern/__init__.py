"""Spark-native analytics over retrieval-augmented-generation corpora."""
