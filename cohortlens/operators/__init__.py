"""Operators: flat tables at their natural grain, plus nesting and contract checks."""
