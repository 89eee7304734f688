"""Operators for large text corpora: tokenising, deduplication, scoring, mixing, sharding.

Nothing else in the library imports this subpackage.
"""
