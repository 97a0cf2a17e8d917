"""Column expressions: Column in, Column out, no Python in the plan."""
