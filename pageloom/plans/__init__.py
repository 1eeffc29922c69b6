"""Compositions of operators: what a user asks for in one call."""
