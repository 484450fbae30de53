"""Operators: ledgers and reports, lookups, budgets, near-duplicates, retrieval, chunking, replay."""
