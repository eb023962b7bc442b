"""Exact vector search and vector analytics as Spark plans."""
