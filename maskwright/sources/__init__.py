"""Archives in and out, and a generator of test archives."""
