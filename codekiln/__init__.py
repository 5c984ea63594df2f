"""Spark-native analytics over source files, compiler output and benchmark runs."""
