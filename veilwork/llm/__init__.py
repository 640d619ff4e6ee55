"""Operators for preparing training text: filtering, deduplication, masking, scoring, tokens and packing."""
