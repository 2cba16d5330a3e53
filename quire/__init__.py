"""Quire: a PySpark-native document-analytics engine."""
