"""Registering, mapping, reading and writing tables."""
