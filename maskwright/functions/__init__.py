"""Fixed values and column functions."""
