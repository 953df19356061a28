"""lineloom: a Spark-native engine for line-oriented text data."""

__version__ = "0.1.0"
