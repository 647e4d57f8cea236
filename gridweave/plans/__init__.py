"""Queries over the given tables, with the same SQL for comparison."""
