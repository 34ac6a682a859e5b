"""Spark-native analytics for document collections and retrieval evaluation."""

__version__ = "0.1.0"
