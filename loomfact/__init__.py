"""loomfact: a Spark-first analytics engine for typed facts."""
