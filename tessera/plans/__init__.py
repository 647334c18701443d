"""Schemas, flag-carrying tables and the predicate language."""
