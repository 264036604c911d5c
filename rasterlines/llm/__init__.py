"""Operators for preparing large training-text corpora.

Each module holds one operator with a general interface, its real outputs, and
the thin ``opN_*`` query that applies it to a whole table.  Nothing outside
this subpackage imports it.
"""
