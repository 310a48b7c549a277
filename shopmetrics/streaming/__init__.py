"""Incremental sync of newly landed files."""
