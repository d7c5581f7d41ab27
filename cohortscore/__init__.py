"""Cohort-risk analytics as Spark DataFrame, SQL and MLlib operations."""
