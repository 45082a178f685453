"""terrarow: a PySpark-native engine for row-structured field surveys."""
