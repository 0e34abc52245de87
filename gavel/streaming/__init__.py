"""Structured Streaming forms of the job-transport operators."""
