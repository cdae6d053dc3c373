"""Training-data operators: quality, deduplication, decontamination, tokens, archives, packing.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
