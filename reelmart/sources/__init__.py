"""Readers: CSV files and relational tables."""
