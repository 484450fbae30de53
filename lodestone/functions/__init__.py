"""Column functions: text and tokens, identity, cost, vectors."""
