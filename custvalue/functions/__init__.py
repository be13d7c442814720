"""Column expressions: nulls, text, lists, times. All built from Spark's own functions."""
