"""Scalar, aggregate, array, JSON and date functions by name."""
