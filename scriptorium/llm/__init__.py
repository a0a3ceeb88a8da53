"""Operators for large text collections: dedup, language, extraction, mixing, tokens, archives."""
