"""Spark-native scoring of read-aloud recordings."""
