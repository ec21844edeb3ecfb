"""Column functions: text, classification, numbers and vectors."""
