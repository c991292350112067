"""Metric-log analytics and data preparation on PySpark."""
