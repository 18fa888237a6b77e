"""Training-data operators: tokenising, filtering, deduplication, mixing and archive handling."""
