"""Relational operators and the per-cell kernel."""
