"""Relational operators on flag-carrying tables."""
