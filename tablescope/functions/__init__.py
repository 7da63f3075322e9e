"""Column expressions and the few closed-form statistics Spark has no function for."""
