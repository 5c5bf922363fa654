"""Operators for building training corpora: deduplication, scoring, tokenising, packing, search."""
