"""Scalar functions on sequences, identifiers and ranges, as column expressions."""
