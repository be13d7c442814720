"""Licence-purchase and revenue models on Spark ML."""
