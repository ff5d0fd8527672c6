"""Operators for preparing training text: scans, deduplication, filtering, packing and archives.

Nothing else in the library imports this subpackage.
"""
