"""Training-data operators: filters, deduplication, mixing, packing and formatting of text corpora."""
