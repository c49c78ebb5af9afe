"""Dataset governance and group-aware model evaluation as Spark DataFrame jobs."""
