"""Operators on training data: mixing, overlap, neighbours, encoding, leaks and residue."""
