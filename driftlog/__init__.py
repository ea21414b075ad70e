"""driftlog: a Spark-first engine for convergent event logs and keyed tables."""
