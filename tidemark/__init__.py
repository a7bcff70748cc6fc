"""Customer-acquisition analytics expressed as Spark DataFrame jobs."""
