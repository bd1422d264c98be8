"""Training-data operators: scoring, deduplication, search, packing and encoding of text corpora."""
