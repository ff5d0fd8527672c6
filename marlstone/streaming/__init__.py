"""Incremental imports."""
