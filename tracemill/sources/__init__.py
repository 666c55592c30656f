"""sources of the process-log engine."""
