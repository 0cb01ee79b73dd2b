"""Spark-native telemetry evidence and robust inference."""
