"""Training-data pipeline operators: filtering, deduplication, mixing, formatting, counting."""
