"""Spark engine for auditing early-stopping decisions over step-by-step run logs."""
