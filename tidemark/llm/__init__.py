"""Training-data operators: language id, tokenisation, sharding, fingerprints,
vector search, token files, packing, near duplicates and quality selection.

Nothing outside this subpackage imports it.
"""
