"""Raster and matte evaluation on PySpark."""
