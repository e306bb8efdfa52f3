"""Queries composed from operators, each paired with its SQL statement."""
