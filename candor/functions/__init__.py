"""Column expressions: text, arrays and seeded hashing.  No Python UDFs."""
