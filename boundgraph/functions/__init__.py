"""Column functions over properties, names and order."""
