"""Business analytics, retrieval and document processing as Spark DataFrame jobs."""
