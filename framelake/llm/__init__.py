"""Training-data operators: near-duplicate removal, filters, tokenisation, packing and search."""
