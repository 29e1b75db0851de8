"""Column functions: names, demographics, metrics, text and vectors."""
