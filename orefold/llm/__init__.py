"""Training-data operators: fingerprints, near-duplicate search, mixing, scoring, extraction, tokens and archives."""
