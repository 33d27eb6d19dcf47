"""Streaming of the abuse-analytics engine."""
