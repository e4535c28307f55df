"""Operators for training-data pipelines: scans, deduplication, search, tokens, filters, archives.

Nothing else in the library imports this subpackage.
"""
