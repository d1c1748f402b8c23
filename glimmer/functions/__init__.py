"""Column functions: text, URLs, arithmetic. All are native expressions."""
