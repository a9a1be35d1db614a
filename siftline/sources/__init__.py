"""Reading and writing: CSV, prepared tables, metric documents, models."""
