"""Operators for preparing large text corpora (deduplication, cleaning, tokenising).

Nothing outside this package imports it; it may import the library's helpers."""
