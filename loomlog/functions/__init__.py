"""Column expressions: identifiers, version algebra, names and payloads."""
