"""A PySpark-native engine for a richly typed analytic SQL dialect."""
