"""Column expressions over paths, text and identities."""
