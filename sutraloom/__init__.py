"""Spark-native document analytics, retrieval and corpus preparation."""

__version__ = "0.1.0"
