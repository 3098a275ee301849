"""Cohort and molecular analytics as Spark DataFrame operators."""
