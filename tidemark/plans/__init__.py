"""Composed queries of the operators on the driver tables, each with its own SQL for comparison."""
