"""Column functions on bits, residues and codes."""
