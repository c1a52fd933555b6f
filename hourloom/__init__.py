"""Timesheet consolidation as Spark DataFrame, SQL and Structured Streaming jobs."""
