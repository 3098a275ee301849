"""streaming of the cohort engine."""
