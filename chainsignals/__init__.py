"""On-chain signal analytics as Spark jobs."""
