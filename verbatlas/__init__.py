"""Spark-native analytics for predicate-argument text and its annotation."""

__version__ = "0.1.0"
