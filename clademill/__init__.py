"""Spark-native engine for comparative sequence analysis."""
