"""Readers, writers and the two vendor products."""
