"""Column functions; Python only where no built-in expression exists."""
