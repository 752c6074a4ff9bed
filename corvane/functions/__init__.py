"""Column functions: predicates of the pattern language and text helpers."""
