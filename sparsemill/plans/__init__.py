"""Queries over tables, their SQL, and text reports."""
