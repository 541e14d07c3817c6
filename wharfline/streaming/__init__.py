"""Structured Streaming forms of operators that make sense on unbounded input."""
