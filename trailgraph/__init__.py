"""Graph analytics with provenance, as Spark DataFrame jobs."""

from trailgraph.graph import PropertyGraph

__all__ = ["PropertyGraph"]
