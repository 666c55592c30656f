"""operators of the process-log engine."""
