"""Column builders: pure expressions that stay inside generated code."""
