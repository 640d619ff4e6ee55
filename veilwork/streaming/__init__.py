"""Masking of unbounded tables."""
