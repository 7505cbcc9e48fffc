"""Operators for preparing training text at scale (filters, extraction, dedup, packing, search).

Nothing else in the library imports this subpackage. ``queries`` holds the thin
registered queries; every operator module has its own general interface.
"""
