"""Column-level helpers: every function here takes Columns and returns a Column."""
