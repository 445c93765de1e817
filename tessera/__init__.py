"""Spark-native engine for indexing and searching corpora of text and source code."""

__version__ = "0.1.0"
