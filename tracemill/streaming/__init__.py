"""streaming of the process-log engine."""
