"""Queries over the driver tables, with the SQL each must agree with."""
