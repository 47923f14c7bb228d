"""Scalar functions as Spark columns: URLs, domains, statuses, text fields."""
