"""Spark-native analytics over large libraries of captured text."""
