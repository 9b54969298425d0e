"""Column expressions: parsing, normalisation, hashing and small statistics."""
