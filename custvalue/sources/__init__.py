"""Reading and writing: CSV, JSON answers, table snapshots."""
