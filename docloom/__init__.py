"""docloom: product documentation to a searchable vector index, as Spark jobs."""
