"""Training-data operators: quality, toxicity, de-duplication, PII, mixing, packing, archives, search."""
