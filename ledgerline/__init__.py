"""Spark-native analytics for registries of scanned land documents."""
