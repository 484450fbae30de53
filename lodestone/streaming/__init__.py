"""Structured Streaming forms of deduplication, live counters and expiry."""
