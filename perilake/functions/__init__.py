"""Column expressions: parsing, numeric rules, text templates."""
