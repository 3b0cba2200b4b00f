"""Column expressions: functions from Columns to Columns."""
