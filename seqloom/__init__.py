"""Spark-native mapping of short reference sequences to long reads."""
