"""Spark-native analytics for field surveys: tracks, roads, evidence, models."""
