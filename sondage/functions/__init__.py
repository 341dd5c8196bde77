"""Column expressions: draws, text parsing, range smoothing and row rules."""
