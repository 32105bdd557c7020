"""Functions of docstrata."""
