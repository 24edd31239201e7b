"""A PySpark-native engine for execution traces."""
