"""Column expressions: flags, CIGAR strings, keys, scores."""
