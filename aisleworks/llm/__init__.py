"""Operators for preparing training text: packing, deduplication, filtering, mixing, extraction."""
