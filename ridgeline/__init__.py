"""Ridgeline: security-alert correlation as DataFrame and SQL plans on Spark."""
