"""operators of the cohort engine."""
