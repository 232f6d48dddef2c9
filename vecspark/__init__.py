"""A PySpark-native vector-search engine."""
