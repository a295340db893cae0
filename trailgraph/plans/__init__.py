"""How the work is laid out on the cluster: edge layouts, skew-safe lookups,
and the round loop."""
