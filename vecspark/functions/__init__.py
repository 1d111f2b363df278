"""Column functions for vectors, sequences and report fields."""
