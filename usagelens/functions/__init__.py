"""Column functions: names, time, keys, predicates, JSON and number formatting."""
