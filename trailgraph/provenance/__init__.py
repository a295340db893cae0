"""Which graph came from which, kept as tables; and capture of snapshots."""
