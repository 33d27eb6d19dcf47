"""Sources of the abuse-analytics engine."""
