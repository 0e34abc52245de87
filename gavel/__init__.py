"""Submission-judging analytics on Spark DataFrames."""
