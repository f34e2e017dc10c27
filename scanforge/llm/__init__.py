"""Training-data operators: chat formatting, filtering, deduplication, scoring and packing.

Nothing outside this subpackage imports it.
"""
