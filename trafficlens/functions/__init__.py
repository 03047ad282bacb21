"""Column expressions over log fields."""
