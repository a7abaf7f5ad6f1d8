"""Queries over the driver's tables, with the SQL they must agree with."""
