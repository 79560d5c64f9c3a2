"""Corpus preparation and training-log analytics as Spark DataFrame jobs."""
