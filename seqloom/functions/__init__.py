"""Sequence constants and functions on strings and columns."""
