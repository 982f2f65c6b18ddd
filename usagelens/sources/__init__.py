"""Readers, normalisers of raw records, and writers."""
