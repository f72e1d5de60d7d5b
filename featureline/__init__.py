"""Feature, training and batch-scoring work on large tables, written as Spark jobs."""
