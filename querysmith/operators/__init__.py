"""Relational operators over entities, terms, queries and results."""
