"""Household-survey panel analytics as Spark DataFrame operators."""
