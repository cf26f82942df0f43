"""Spark-native analytics for transcripts and conversations."""

__version__ = "0.1.0"
