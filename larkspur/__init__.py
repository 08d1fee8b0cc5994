"""larkspur: a Spark-native recall-and-context engine with data-quality and corpus operators."""

__version__ = "0.1.0"
