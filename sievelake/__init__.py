"""Spark-native analytics over event records and documents."""
