"""Readers for graphs, descriptors, expected results and run logs."""
