"""Operators for preparing training text, with their queries."""
