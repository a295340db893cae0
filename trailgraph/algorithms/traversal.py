"""Breadth-first search and single-source shortest paths."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from trailgraph.algorithms.common import message_passing, preparation
from trailgraph.graph import PropertyGraph
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.plans.rounds import relax
from trailgraph.provenance import events
from trailgraph.workspace import Workspace

UNREACHED_DEPTH = 9223372036854775807
UNREACHED_DISTANCE = float("inf")


def _from_source(source: int, value_type: str, unreached):
    start = F.when(F.col("id") == source, F.lit(0)).otherwise(F.lit(unreached))
    return start.cast(value_type)


def _search(graph, source, event, value_type, unreached, message, weighted, prepared):
    value = _from_source(source, value_type, unreached)
    with preparation(graph, prepared) as ready:
        initial = ready.vertices.select(
            "id", value.alias("value"), (F.col("id") == source).alias("changed")
        )

        def setup(start: PropertyGraph) -> PropertyGraph:
            mapped = replace(start, vertices=ready.vertices).map_vertices(value)
            return mapped.map_edges(F.col("attr").cast("double")) if weighted else mapped

        def run(recorder) -> DataFrame:
            workspace = Workspace(ready.spark, event.event_name.lower())
            state = relax(workspace, ready.outgoing, initial, message, on_round=recorder).table
            result = state.df.select("id", F.col("value").alias("attr"))
            if not state.path:
                # The source reaches nothing, or is no vertex of the graph.
                result = workspace.write("unreached", result).df
            return result

        return message_passing(graph, event, setup, run)


def bfs(
    graph: PropertyGraph, source: int, prepared: PreparedGraph | None = None
) -> PropertyGraph:
    """Hops from ``source`` along the edges; ``UNREACHED_DEPTH`` where none."""
    return _search(
        graph,
        source,
        events.algorithm("BFS", source),
        "bigint",
        UNREACHED_DEPTH,
        F.col("value") + 1,
        False,
        prepared,
    )


def sssp(
    graph: PropertyGraph, source: int, prepared: PreparedGraph | None = None
) -> PropertyGraph:
    """Least sum of edge weights from ``source``; infinite where unreached."""
    return _search(
        graph,
        source,
        events.algorithm("SSSP", source),
        "double",
        UNREACHED_DISTANCE,
        F.col("value") + F.col("attr").cast("double"),
        True,
        prepared,
    )
