"""Communities by synchronous label propagation."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from trailgraph.algorithms.common import message_passing, preparation
from trailgraph.graph import PropertyGraph
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.plans.rounds import Recent, Round, write_round
from trailgraph.provenance import events
from trailgraph.workspace import Table, Workspace


def cdlp(
    graph: PropertyGraph, max_iter: int, prepared: PreparedGraph | None = None
) -> PropertyGraph:
    """After ``max_iter`` rounds, the label each vertex has: in a round it takes
    the most frequent label among its neighbours, the smallest of equals.

    An edge is seen from both ends, so a reciprocal pair counts twice.  A vertex
    without edges keeps its own id.
    """
    if max_iter <= 0:
        raise ValueError(f"the number of iterations must be above 0, got {max_iter}")
    with preparation(graph, prepared) as ready:

        def setup(start: PropertyGraph) -> PropertyGraph:
            return replace(start, vertices=ready.vertices).map_vertices("id")

        def run(recorder) -> DataFrame:
            return _rounds(ready, max_iter, recorder)

        return message_passing(graph, events.algorithm("CDLP", max_iter), setup, run)


def _rounds(ready: PreparedGraph, max_iter: int, observer) -> DataFrame:
    workspace = Workspace(ready.spark, "cdlp")
    state = Table(ready.vertices.select("id", F.col("id").alias("value")), "")
    recent = Recent(workspace)
    zero = F.lit(0).cast("bigint")
    for number in range(max_iter):
        started = time.perf_counter_ns()
        sent = ready.both_ways.meet(state.df).select(F.col("dst").alias("id"), "value", "n")
        histogram = (
            sent.unionByName(state.df.select("id", "value", zero.alias("n")))
            .groupBy("id", "value")
            .agg(F.sum("n").alias("n"))
        )
        chosen = histogram.groupBy("id").agg(
            F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("label"))).alias("best")
        )
        labels = chosen.select("id", F.col("best.label").alias("value"))
        following, metrics = write_round(workspace, f"round={number}", labels, number, observer)
        if observer is not None:
            elapsed = time.perf_counter_ns() - started
            observer(Round(number, following.df, None, None, elapsed, metrics))
        state = recent.add(following)
    if observer is not None:
        observer.finish()
    recent.keep_last()
    return state.df.select("id", F.col("value").alias("attr"))
