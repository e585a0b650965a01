"""Column expressions and reusable aggregate compositions."""
