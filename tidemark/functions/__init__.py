"""Column expressions: numeric guards, text rules, face geometry and seeded shuffles."""
