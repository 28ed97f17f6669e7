"""Front ends: fluent traversals, traversal text, pattern language, schema."""
