"""Conversions, products, partitions, halo ranges and measurement analysis."""
