"""Column-expression builders: casts, time, masking, rule predicates."""
