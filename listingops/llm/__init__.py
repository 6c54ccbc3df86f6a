"""Operators for preparing training text: scans, packing, sharding, dedup, search, classifiers.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
