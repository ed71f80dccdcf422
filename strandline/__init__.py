"""Spark-native analytics over session telemetry, and corpus preparation operators."""
