"""Spark-native analytics over multi-turn dialogue data."""
