"""Whole plans: test encounters, the report pipeline and the query registry."""
