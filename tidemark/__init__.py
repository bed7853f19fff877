"""Cyclic-event enrichment analytics on Spark."""
