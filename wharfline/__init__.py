"""Time-and-motion analytics of event-driven operations, as functions on Spark DataFrames."""
