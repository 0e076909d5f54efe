"""Semantic graph analytics on Spark."""
