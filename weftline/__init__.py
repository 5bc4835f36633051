"""Weftline: web pages and training text as Spark tables."""
