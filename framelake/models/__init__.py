"""Models: training, scoring and decoding as DataFrame aggregations."""
