"""Spark-native research analytics on ordered bars: expressions, back-tests, statistics, selection, streaming."""
