"""Structured Streaming forms of the job feed."""
