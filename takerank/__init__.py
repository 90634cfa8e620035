"""takerank: a Spark-native engine for ranking recorded takes and their best stretches."""

__version__ = "0.1.0"
