"""Snapshots, results and reports written to storage."""
