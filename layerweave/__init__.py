"""Multi-layer people-network analytics, written as Spark DataFrame jobs."""
