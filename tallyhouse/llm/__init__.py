"""Operators for large text collections: identification, counting, search, duplicates, mixing."""
