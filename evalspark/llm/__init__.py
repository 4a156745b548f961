"""Corpus operators for language-model training data: filtering, deduplication, packing, search, mixing, formatting."""
