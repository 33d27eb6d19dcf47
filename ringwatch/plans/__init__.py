"""Plans of the abuse-analytics engine."""
