"""Operators for large text corpora; their queries are in ``queries``."""
