"""Operators for preparing training text: deduplication, packing, search, tokens, language, privacy, archives."""
