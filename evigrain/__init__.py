"""Spark-native budgeted evidence retrieval and data-processing engine."""

__version__ = "0.1.0"
