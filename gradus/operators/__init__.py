"""Relational operators over evaluation data."""
