"""Spark-native engine for deterministic spatio-temporal scalar fields."""
