"""Column expressions: cleaning, parsing and classification of text, numbers and dates."""
