"""Column functions: each takes and returns columns, options are literals that are checked when the plan is built."""
