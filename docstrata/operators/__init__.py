"""Operators of docstrata."""
