"""Column functions: text, vectors, dates and references."""
