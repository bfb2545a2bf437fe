"""gaitwright: Spark-first analytics for trial-based, multi-sensor rehabilitation data."""
