"""Whole jobs, built from the operators: one per data source, then the customer table,
the profile and the models."""
