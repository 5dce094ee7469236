"""Operators: functions from DataFrame to DataFrame, grouped by the data they work on."""
