"""Spark-native content inventory, deduplication and similarity analytics."""
