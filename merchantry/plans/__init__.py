"""Models: cleaned staging tables, facts and dimensions, metrics and checks."""
