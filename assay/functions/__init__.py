"""Column expressions: predicates, rules, outcomes, keys, times and text."""
