"""Spark-native analytics for device telemetry: parsing, joins, series, sequential tests, detectors."""
