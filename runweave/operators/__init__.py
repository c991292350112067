"""Operators of the metric-log engine."""
