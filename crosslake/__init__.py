"""A PySpark-native analytics engine over many named data sources."""
