"""Queries over the given tables, each with the SQL it must agree with where SQL can say it."""
