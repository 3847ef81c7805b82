"""Queries over the driver's tables and SQL that gives the same rows."""
