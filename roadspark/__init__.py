"""A PySpark-native engine for surveyed road-network data."""
