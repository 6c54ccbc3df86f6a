"""Column functions: text, numbers, search terms, hashes."""
