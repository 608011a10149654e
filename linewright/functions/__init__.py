"""Column functions: text predicates, strict JSON, hashing and tokens."""
