"""Operators for large text collections: counting, duplicates, groups, spans, tokens, leaks, quality."""
