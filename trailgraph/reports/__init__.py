"""Reports over run logs: time and storage cost of provenance."""
