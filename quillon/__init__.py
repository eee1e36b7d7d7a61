"""Spark-native analytics over operational telemetry."""
