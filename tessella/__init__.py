"""A PySpark-native multi-model analytics engine."""
