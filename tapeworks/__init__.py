"""tapeworks: equity-flow analytics as Spark DataFrame operators and jobs."""
