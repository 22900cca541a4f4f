"""Training-data operators: packing, deduplication, filtering, sharding, decontamination."""
