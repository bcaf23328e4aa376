"""Spark-native analytics over crawled-site evidence and text corpora."""
