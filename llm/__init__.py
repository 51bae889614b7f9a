"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface plus the thin ``opN_*`` query built on it.
"""
