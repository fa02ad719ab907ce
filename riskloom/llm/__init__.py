"""Training-data operators: sharding, scans, near duplicates, mixing, tokens, quality. Nothing else in the library imports this."""
