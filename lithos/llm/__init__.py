"""Training-data operators: HTML extraction, secret scans, BPE, exact top-k, packing,
near-duplicate removal, language ID, media columns, substring dedup, token counts.

Nothing else in the library imports this subpackage.
"""
