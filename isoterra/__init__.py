"""Terrain-grid analytics expressed as Spark DataFrame operations."""
