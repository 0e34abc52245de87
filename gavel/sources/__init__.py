"""Readers and writers: JSON lines, catalogue tables, job streams."""
