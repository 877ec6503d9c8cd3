"""Readers, writers and fixed lookup tables."""
