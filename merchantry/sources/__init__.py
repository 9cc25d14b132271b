"""Reading raw exports, loading them, auditing them, and writing tables."""
