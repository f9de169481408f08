"""Spark-native document analytics: extraction, validation, catalog and search as DataFrame plans."""
