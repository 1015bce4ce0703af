"""Relational operators over texts and spans."""
