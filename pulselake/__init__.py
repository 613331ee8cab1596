"""Spark-native analytics over daily telemetry, documents and training corpora."""
