"""Column expressions: ring positions, byte fields, wrapping sums, buckets."""
