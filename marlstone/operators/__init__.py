"""Relational operators, predicates, constraints and changes, all as DataFrame transformations."""
