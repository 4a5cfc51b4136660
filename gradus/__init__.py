"""A PySpark-native engine for keyed, categorical evaluation data."""
