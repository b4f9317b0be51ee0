"""Spark-native entity linking and corpus processing."""
