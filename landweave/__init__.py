"""Raster and patch analytics as DataFrame-to-DataFrame functions on Spark."""
