"""Governed metrics and data processing on Spark."""
