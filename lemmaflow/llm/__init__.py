"""Operators on training text: leaked evaluation passages, source mixing, truncated texts."""
