"""Spark-native analytics over API contracts: diff, rename inference, site matching, edits, history."""

__version__ = "0.1.0"
