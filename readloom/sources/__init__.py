"""Readers and writers of record files, and the tables that queries derive sequences from."""
