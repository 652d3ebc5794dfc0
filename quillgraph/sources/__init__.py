"""Readers, writers and the extractor over structured tables."""
