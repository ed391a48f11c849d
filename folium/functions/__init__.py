"""Column functions: normalisation, tokens, identifiers, and scanners that need Arrow batches."""
