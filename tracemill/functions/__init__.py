"""functions of the process-log engine."""
