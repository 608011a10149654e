"""Operators for preparing training data: sharding, dedup, PII, scoring, packing, formatting."""
