"""Subpackage of the geospatial engine."""
