"""Functions of the abuse-analytics engine."""
