"""Training-data operators: dedup, packing, sharding, tokenizing, scoring and search.

Nothing else in the library imports this subpackage.
"""
