"""Column-to-column building blocks; nothing here starts a job."""
