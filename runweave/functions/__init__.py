"""Functions of the metric-log engine."""
