"""Training-data operators: language mixture, deduplication, quality, extraction, scoring and token output."""
