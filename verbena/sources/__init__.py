"""Readers of source formats."""
