"""Operators for large text corpora; nothing outside this sub-package imports it."""
