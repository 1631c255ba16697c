"""Column builders and plan-time rules on column names."""
