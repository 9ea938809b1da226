"""Training-data operators: deduplication, filtering, mixing, tokenising, packing and search.

Nothing outside this subpackage imports it.
"""
