"""Column functions: they take and return `Column` and never trigger a job."""
