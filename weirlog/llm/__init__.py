"""Training-data operators: mixing, quality, near-duplicates, archives, extraction, URL filters, toxicity, packing."""
