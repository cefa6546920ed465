"""Column functions: text normalisation, Unicode forms, edit distances, code conversions."""
