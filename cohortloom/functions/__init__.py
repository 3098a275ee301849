"""functions of the cohort engine."""
