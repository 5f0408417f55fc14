"""Column expressions: no state, no Python on the executors."""
