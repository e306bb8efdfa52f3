"""Column-to-Column functions built from native expressions."""
