"""Column functions: deterministic sampling keys, vector arithmetic, partition arithmetic."""
