"""Half-year text-drift analytics on Spark."""
