"""Operators for preparing training corpora: filters, near-duplicates, mixing, packing, search and scoring."""
