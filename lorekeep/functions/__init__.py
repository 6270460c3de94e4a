"""Column expressions: tokens, filters, templates, scorers."""
