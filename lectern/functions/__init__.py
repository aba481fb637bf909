"""Column expressions: text, vectors, routing signals and content rules."""
