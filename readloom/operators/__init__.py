"""Relational operators on reads, k-mers, hits and overlaps."""
