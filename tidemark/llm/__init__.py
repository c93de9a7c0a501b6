"""Training-data operators: tokens, packing, near-duplicates, quality, toxicity, mixing, sharding, neighbours."""
