"""Column functions: Column in, Column out, no Python in the tasks."""
