"""Driving-risk analytics as Spark DataFrame jobs."""
