"""Training-data operators: formatting, encoding, deduplication, scoring, search and mixing.

Nothing outside this subpackage imports it.
"""
