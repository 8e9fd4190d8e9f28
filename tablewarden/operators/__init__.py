"""Operators: checks, repairs, planting, parsing, scoring and review, all from DataFrame to DataFrame."""
