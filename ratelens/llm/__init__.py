"""Operators that prepare training data: sharding, language, duplicates, packing, fingerprints, tokens, scores, search, URLs."""
