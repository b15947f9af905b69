"""Spark-native analytics engine for sports statistics and slate decision support."""
