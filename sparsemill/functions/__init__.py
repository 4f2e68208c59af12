"""Column expressions on vectors, weights, bitmaps and utility values."""
