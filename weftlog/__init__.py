"""Spark-native event-log analytics: preparation, languages, transport distances, resampling tests, interval and feature operators."""

__version__ = "0.1.0"
