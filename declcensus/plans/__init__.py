"""Plans: complete runs, and the registered queries with their SQL checks."""
