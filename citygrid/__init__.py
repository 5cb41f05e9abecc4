"""Urban-growth and economic-activity analytics as Spark DataFrame jobs."""
