"""Streaming vector search and key-value analytics as Spark plans."""

__version__ = "0.1.0"
