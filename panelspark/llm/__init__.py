"""Operators of a training-data pipeline: filters, de-duplication, sharding, tokens."""
