"""Keep a vector table in step with a file tree and search it, on Spark."""
