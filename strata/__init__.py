"""strata: a PySpark-native time-series analytics engine."""
