"""Value semantics, predicates, scalar functions and geometry as Columns."""
