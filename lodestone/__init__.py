"""Document retrieval, auditing and corpus preparation on Apache Spark."""
