"""Column functions; all built-in, no Python in the tasks."""
