"""Column functions: identities, text, scoring."""
