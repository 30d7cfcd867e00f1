"""Column-level building blocks: roles, text parsing, date parts."""
