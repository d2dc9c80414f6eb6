"""Whole studies: overlap with the reference, generators, scale, reports."""
