"""Operators for corpora of training text: scans, deduplication, filters, mixing, extraction and counts."""
