"""Operators of the abuse-analytics engine."""
