"""Column expressions: text, labels, URLs, HTML, dates and small vector arithmetic."""
