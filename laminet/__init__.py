"""Multilayer network analytics on Spark: see README.md for the map of the package."""

__version__ = "0.1.0"
