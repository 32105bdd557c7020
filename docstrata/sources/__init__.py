"""Sources of docstrata."""
