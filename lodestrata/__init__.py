"""Spark-native evidence retrieval and knowledge analytics over tables of documents and queries."""
