"""Training-data operators: extraction, filtering, near-duplicates, tokens, packing, scoring, archives."""
