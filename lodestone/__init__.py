"""Retrieval analytics on Spark: a DataFrame-first engine (see README.md)."""

__version__ = "0.1.0"
