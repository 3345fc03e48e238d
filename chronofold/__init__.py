"""chronofold: change-log and corpus analytics written as plain Spark jobs."""
