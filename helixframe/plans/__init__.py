"""Composite plans and the query catalogue bound to the driver tables."""
