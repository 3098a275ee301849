"""plans of the cohort engine."""
