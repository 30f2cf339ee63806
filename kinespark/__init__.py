"""Spark-native analytics for inertial and optical motion capture."""
