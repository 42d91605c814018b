"""Training-data operators: quality, safety, deduplication, mixing and packing."""
