"""Retrieval and code-intelligence analytics expressed as Spark DataFrame jobs."""
