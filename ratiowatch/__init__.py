"""Credit-risk and business-data analytics as Spark DataFrame jobs."""
