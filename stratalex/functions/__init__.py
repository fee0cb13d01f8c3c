"""Column functions: text, dates, labels and identifiers."""
