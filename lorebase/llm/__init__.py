"""Operators for large training corpora: filters, extraction, duplicates, tokens, packing, archives."""
