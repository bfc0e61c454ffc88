"""Indexing and searching lists of internet domain names on Spark."""
