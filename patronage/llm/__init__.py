"""Operators for preparing training data from large corpora; nothing else in the library imports this."""
