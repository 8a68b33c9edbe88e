"""codeloom: a PySpark-native engine for source-code metadata, graphs and retrieval."""

__version__ = "0.1.0"
