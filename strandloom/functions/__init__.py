"""Column helpers: intervals, chains, sequences."""
