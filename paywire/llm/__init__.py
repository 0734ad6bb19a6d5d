"""Training-data operators: token files, filters, scoring, dedup, packing."""
