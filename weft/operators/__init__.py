"""Relational operators: DataFrame in, DataFrame out, no driver-side rows."""
