"""Paged-text analytics on Spark."""
