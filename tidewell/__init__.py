"""A Spark-native retrieval and knowledge analytics engine."""

__version__ = "0.1.0"
