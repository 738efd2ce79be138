"""Customer-retention analytics on order lines, expressed as Spark DataFrame jobs."""
