"""Spark-first analytics over listing-style captures."""
