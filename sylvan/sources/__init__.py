"""Trees from tables and texts, as node tables: one row for each node of each document."""
