"""Training-data operators: dedup, tokenization, packing, scans, scoring, quality.

Nothing outside this subpackage imports it.
"""
