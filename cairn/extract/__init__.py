"""Source text to rows: symbols, imports, calls, variables and flows."""
