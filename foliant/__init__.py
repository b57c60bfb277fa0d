"""Spark-native analytics over long documents."""
