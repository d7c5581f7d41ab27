"""Training-data operators: dedup, quality, scoring, tokenising, packing, page and URL filters."""
