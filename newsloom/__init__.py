"""Ranked-digest analytics as Spark DataFrame operators."""
