"""Evidence consensus analytics as Spark DataFrame jobs."""
