"""Column functions; nothing here reads data or starts a job."""
