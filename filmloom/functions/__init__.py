"""Column helpers. Each takes and returns columns, so Catalyst sees plain expressions."""
