"""A PySpark-native analytics engine for reporting estates."""
