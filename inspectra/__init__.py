"""Inspection data jobs and training-data jobs as Spark DataFrame programs."""
