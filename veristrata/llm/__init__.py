"""Operators of a training-data pipeline: dedup, scoring, mixing, packing, archives.

Nothing else in the library imports this subpackage.
"""
