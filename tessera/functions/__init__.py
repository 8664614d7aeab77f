"""Column functions: text, predicates, intervals."""
