"""Readers, writers and the business views over the given tables."""
