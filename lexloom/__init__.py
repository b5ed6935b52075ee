"""Spark-native analytics for curated text collections."""

__version__ = "0.1.0"
