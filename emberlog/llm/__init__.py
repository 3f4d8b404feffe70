"""Operators for preparing large text corpora: deduplication, packing, scoring, search."""
