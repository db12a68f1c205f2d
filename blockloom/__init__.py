"""A Spark-native engine over block-compressed byte data."""

__version__ = "0.2.0"
