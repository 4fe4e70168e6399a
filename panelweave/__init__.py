"""Market-panel analytics and corpus preparation as Spark DataFrame jobs."""
