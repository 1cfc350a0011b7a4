"""tidemark: PySpark-native analytics over crawl observations and training-data tables."""

__version__ = "0.1.0"
