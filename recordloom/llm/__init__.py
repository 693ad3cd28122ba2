"""Operators for large training-data jobs (one module per operator)."""
