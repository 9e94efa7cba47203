"""Spark-native lexical search and corpus analytics over columnar documents."""

__version__ = "0.1.0"
