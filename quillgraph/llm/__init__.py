"""Training-data operators: near-duplicate removal, quality, packing, mixing and encoding."""
