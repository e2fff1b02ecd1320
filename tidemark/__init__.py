"""tidemark: labelled, versioned event data and training corpora as Spark jobs."""
