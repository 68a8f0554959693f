"""Media-authenticity analytics as plain Spark jobs."""
