"""sources of the cohort engine."""
