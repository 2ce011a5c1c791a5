"""Spark-first analytics over media-project catalogs."""
