"""Column functions: text, keys, taxonomies."""
