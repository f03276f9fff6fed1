"""Spark-native analytics over image frames and the telemetry derived from them."""
