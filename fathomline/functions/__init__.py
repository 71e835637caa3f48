"""Column functions: every member takes and returns Columns."""
