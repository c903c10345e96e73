"""Training-data operators (deduplication, mixing, scoring, packing). Nothing else in the library imports this."""
