"""Plans of the metric-log engine."""
