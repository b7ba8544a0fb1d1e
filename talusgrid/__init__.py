"""Raster, vector and risk-ranking analytics as plain Spark jobs."""
