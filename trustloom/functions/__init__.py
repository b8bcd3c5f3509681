"""Column functions: each takes columns and gives a column, so every one runs inside code generation."""
