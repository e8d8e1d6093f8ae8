"""A PySpark-native engine for point-process and time-series analytics."""
