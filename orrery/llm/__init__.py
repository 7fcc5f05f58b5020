"""Operators that prepare training text: filters, deduplication, packing, encoding, search and media columns.

Nothing outside this subpackage imports it.
"""
