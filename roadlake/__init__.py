"""roadlake: a Spark-first analytics engine for road-defect observations."""
