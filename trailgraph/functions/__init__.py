"""Column functions: lists, names, sizes and durations as text."""
