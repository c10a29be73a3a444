"""Column expressions: identifiers, record parsing and distances."""
