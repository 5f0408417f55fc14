"""A PySpark-native engine for limit-order-book and trade streams."""
