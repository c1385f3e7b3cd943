"""Relational operators over DataFrames: join patterns, hierarchies, tagging, windows, nesting."""
