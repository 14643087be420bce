"""Spark-native analytics over storage-fleet and filesystem metadata."""
