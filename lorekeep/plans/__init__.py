"""Gated, staged and logged runs, and the registered queries."""
