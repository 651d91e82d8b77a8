"""Quadrille: geospatial objects, searches and geofences as Spark DataFrames."""

__version__ = "0.1.0"
