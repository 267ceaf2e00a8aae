"""Insurance pricing analytics as Spark jobs."""
