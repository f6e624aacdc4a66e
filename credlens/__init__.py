"""Spark-native scoring of how credible measurement tables look."""
