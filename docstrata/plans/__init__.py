"""Plans of docstrata."""
