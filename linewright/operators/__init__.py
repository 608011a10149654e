"""DataFrame operators: row access, search, lint, fix, dedup, tokens, catalog."""
