"""Relational operators over tiered tables."""
