"""Repository-popularity analytics expressed as Spark DataFrame jobs."""
