"""quern: document and study analytics as Spark jobs."""
