"""Keyed DataFrame operators: assembly, encoding, models, attribution, checks."""
