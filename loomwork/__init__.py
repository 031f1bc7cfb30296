"""Spark-native dataset curation and detection-evaluation engine."""
