"""Streaming of docstrata."""
