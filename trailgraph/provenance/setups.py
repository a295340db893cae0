"""Experiment setups: which of them trace, which store, and what they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.provenance import events
from trailgraph.provenance.session import CaptureFilter, GraphPredicate, ProvEdge

# Setup name with (tracing, storage).
SETUPS = {
    "Baseline": (False, False),
    "Tracing": (True, False),
    "CompleteProvenance": (True, True),
    "ProvenanceGraphPruning": (True, True),
    "DataGraphPruning": (True, True),
    "CombinedPruning": (True, True),
}
PRUNES_GRAPHS = ("ProvenanceGraphPruning", "CombinedPruning")
PRUNES_VERTICES = ("DataGraphPruning", "CombinedPruning")

# The attribute that marks an unreached vertex.
UNREACHED = {
    "BFS": 9223372036854775807,
    "WCC": 9223372036854775807,
    "SSSP": float("inf"),
    "PageRank": 0.0,
}


def flags(setup: str) -> tuple[bool, bool]:
    """(tracing, storage) of a setup."""
    if setup not in SETUPS:
        raise ValueError(f"unknown setup {setup!r}")
    return SETUPS[setup]


def with_flags(runs: DataFrame, setup: str = "setup") -> DataFrame:
    """Runs with the ``tracing`` and ``storage`` flags of their setup."""

    def any_of(position: int) -> Column:
        return F.col(setup).isin([name for name, on in SETUPS.items() if on[position]])

    return runs.withColumn("tracing", any_of(0)).withColumn("storage", any_of(1))


def reached(algorithm: str, column: str = "attr") -> Column:
    """Whether a vertex holds a real value of ``algorithm``."""
    return F.col(column) != F.lit(UNREACHED[algorithm])


def updates_vertices(algorithm: str):
    """Keeps the operation that updates the vertices in each round."""
    name = "outerJoinVertices" if algorithm == "PageRank" else "joinVertices"

    def keep(edge: ProvEdge) -> bool:
        return edge.event == events.operation(name)

    return keep


def capture_for(setup: str, algorithm: str) -> CaptureFilter:
    """The capture filter of a setup."""
    data = GraphPredicate()
    if setup in PRUNES_VERTICES:
        data = GraphPredicate(vertex=reached(algorithm))
    if setup in PRUNES_GRAPHS:
        return CaptureFilter(edge=updates_vertices(algorithm), data=data)
    return CaptureFilter(data=data)
