"""Column expressions: text, fields, fingerprints, scores."""
