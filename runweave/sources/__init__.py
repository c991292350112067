"""Sources of the metric-log engine."""
