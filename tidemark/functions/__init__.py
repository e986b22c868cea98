"""Column builders and vectorised UDFs."""
