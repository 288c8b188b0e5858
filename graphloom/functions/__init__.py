"""Column functions: identities, paths, text."""
