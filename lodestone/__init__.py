"""lodestone: content-addressed deduplication and cost accounting on Spark."""
