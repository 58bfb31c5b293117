"""Patterns and word lists, as data."""
