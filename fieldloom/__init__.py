"""Windowed multi-sensor time-series analytics on Spark."""
