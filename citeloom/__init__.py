"""Grounded retrieval analytics on Spark."""
