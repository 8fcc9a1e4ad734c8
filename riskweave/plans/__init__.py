"""Whole flows and the query catalogue."""
