"""Training-data operators: quality, fingerprints, chat, mixing, packing, dedup, extraction, toxicity, near-dedup, url filters.

Nothing outside this subpackage imports it.
"""
