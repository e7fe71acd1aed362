"""Segmentation, raster and embedding analytics as Spark DataFrame operators."""
