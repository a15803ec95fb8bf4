"""Media and event catalogue analytics expressed as Spark DataFrame jobs."""
