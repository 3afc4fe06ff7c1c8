"""Training-data operators: search, packing, counting, scanning, dedup, encoding, storage, media."""
