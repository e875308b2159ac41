"""Episode catalogue and transcript analytics as Spark DataFrame jobs."""
