"""Whole queries over tables, and the SQL that gives the same rows."""
