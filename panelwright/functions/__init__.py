"""Column expressions: bands, code maps, annuities, calendar arithmetic."""
