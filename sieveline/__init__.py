"""sieveline: a PySpark-native engine for curating and evaluating text and image corpora."""

__version__ = "0.1.0"
