"""Column functions: markdown structure, tokens, metrics."""
