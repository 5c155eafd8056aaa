"""Training-data operators: encoding, fingerprints, deduplication, mixing, filtering and scanning.

Nothing outside this subpackage imports it.
"""
