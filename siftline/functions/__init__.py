"""Column expressions; none of them starts a job."""
