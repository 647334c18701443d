"""Tessera: flag-carrying tables and training-data operators on Spark."""
