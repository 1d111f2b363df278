"""Whole runs over the operators: search, sweeps, analysis, and the registered queries."""
