"""Where node, edge, file, commit and diff tables come from."""
