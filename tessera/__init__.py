"""Retrieval analytics over Spark tables and streams."""
