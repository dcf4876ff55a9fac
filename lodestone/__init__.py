"""A PySpark-native engine for hybrid code and text retrieval."""
