"""tidemark: a PySpark-native analytics engine for daily financial and event data."""

__version__ = "0.1.0"
