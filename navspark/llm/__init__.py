"""Operators for building text corpora; nothing else in the package imports this."""
