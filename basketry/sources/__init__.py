"""Readers, writers and the adapter from the star-schema tables."""
