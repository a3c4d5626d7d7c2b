"""Operators for preparing training text: rules, deduplication, mixing, scoring, tokens, archives."""
