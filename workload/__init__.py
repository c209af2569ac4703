"""Queries over the driver's tables, each with SQL that must give the same rows."""
