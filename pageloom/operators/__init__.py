"""Operators over page, node, text and store tables."""
