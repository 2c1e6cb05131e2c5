"""Operators for large text and vector corpora: sharding, packing, deduplication, filters, mixing, search, scoring."""
