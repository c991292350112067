"""Streaming of the metric-log engine."""
