"""Column functions: XML fields, review text, calendar fields."""
