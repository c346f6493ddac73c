"""Spark-native analytics over property graphs of code, documents and events."""

__version__ = "0.1.0"
