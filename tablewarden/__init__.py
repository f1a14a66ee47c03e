"""Table quality assessment and repair on Spark."""
