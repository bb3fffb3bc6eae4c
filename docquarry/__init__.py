"""Document retrieval analytics and corpus preparation as Spark jobs."""
