"""Scans of survey section files and reads/writes of result tables."""
