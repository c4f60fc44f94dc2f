"""Training-data operators: fingerprints, token counts, language, HTML, search, encoding, near and exact dedup, mixing, WARC.

Nothing outside this package imports it; it may be deleted without breaking the rest.
"""
