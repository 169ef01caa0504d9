"""Operators for training-data pipelines: near duplicates, packing, extraction, quality, sharding, mixing.

Nothing else in the library imports this subpackage.
"""
