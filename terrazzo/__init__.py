"""terrazzo: Spark-native zone statistics with exactly explainable models."""

__version__ = "0.1.0"
