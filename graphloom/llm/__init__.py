"""Training-data operators: near and exact dedup, sharding, PII, language ID, packing, mixing, token counts, toxicity."""
