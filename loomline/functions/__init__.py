"""Column expressions, session helpers and small dense algebra."""
