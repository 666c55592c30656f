"""plans of the process-log engine."""
