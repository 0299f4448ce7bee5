"""Spark-native analytics over conversation archives and their knowledge graph."""
