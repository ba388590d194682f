"""Column expressions over paths, sizes and times."""
