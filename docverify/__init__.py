"""Identity-document verification as Spark jobs."""
