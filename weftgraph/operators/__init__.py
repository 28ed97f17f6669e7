"""Graph operators: lowering of traversals, algorithms, text search, mutations."""
