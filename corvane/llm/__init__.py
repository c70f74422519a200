"""Training-data operators: fingerprints, counts, filters, search, dedup, mixing, tokenising."""
