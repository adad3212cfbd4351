"""Column functions: text, probability and array expressions."""
