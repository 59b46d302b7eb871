"""Collections from Python values and tables, and sinks for results."""
