"""Prefix sums, storage costs and statistics."""
