"""Fleet analytics of flight telemetry, and corpus operators, as Spark jobs."""
