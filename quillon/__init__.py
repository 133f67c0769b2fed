"""Spark-native vector and document retrieval."""
