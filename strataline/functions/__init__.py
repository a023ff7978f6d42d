"""Column builders and small dense linear algebra."""
