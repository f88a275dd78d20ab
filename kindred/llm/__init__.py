"""Training-data operators: language, fingerprints, media, pieces, toxicity,
packing, deduplication, sharding, personal data and set-similarity joins.

Nothing outside this subpackage imports it.
"""
