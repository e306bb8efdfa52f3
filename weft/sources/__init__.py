"""Readers and writers with explicit schemas and error modes."""
