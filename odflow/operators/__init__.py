"""Keyed operators over flow, zone and graph tables."""
