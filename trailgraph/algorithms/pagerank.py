"""PageRank with uniformly spread dangling mass."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from trailgraph.algorithms.common import RoundRecorder, is_traced, preparation
from trailgraph.graph import PropertyGraph
from trailgraph.plans.layout import partitions_for
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.plans.rounds import Recent, Round, write_round
from trailgraph.provenance import events
from trailgraph.workspace import Table, Workspace


def pagerank(
    graph: PropertyGraph,
    num_iter: int,
    damping: float = 0.85,
    prepared: PreparedGraph | None = None,
) -> PropertyGraph:
    """Exactly ``num_iter`` synchronous rounds; the ranks sum to 1.

    A vertex hands its rank out in equal parts over its out-edges, parallel ones
    counted; vertices without out-edges hand theirs to everybody.
    """
    with preparation(graph, prepared) as ready:
        if not is_traced(graph):
            return graph.derive(vertices=_rounds(ready, num_iter, damping, None))
        session = graph.session

        def algorithm() -> PropertyGraph:
            work = session.trace(graph, events.pregel_start(), lambda: _start(graph, ready))
            recorder = _Recorder(work, ready.counts["vertices"])
            vertices = _rounds(ready, num_iter, damping, recorder)
            last = replace(recorder.graph, vertices=vertices)
            return session.trace(
                last, events.pregel_stop(), lambda: last.map_edges(F.lit(None).cast("double"))
            )

        event = events.algorithm("PageRank", num_iter, damping)
        return session.trace(graph, event, algorithm)


class _Recorder(RoundRecorder):
    """Also gauges the vertices of each round."""

    def __init__(self, graph: PropertyGraph, vertices: int):
        super().__init__(graph, "outerJoinVertices")
        self.vertices = vertices

    def __call__(self, finished: Round) -> None:
        super().__call__(finished)
        self.graph.session.gauge(self.graph.node_id, "numVertices", self.vertices)


def _start(graph: PropertyGraph, ready: PreparedGraph) -> PropertyGraph:
    """Degrees on the vertices, then weights on the edges, then first ranks."""
    # Ids and degrees are so few bytes that their join would be merged into tasks
    # of far too many rows; so its partitions are given.
    parts = partitions_for(ready.spark, ready.counts["vertices"])
    known = ready.vertices.repartition(parts, "id")
    degrees = known.select("id", F.col("out_degree").alias("attr"))
    base = replace(graph, vertices=known.select("id"))
    return (
        base.outer_join_vertices(degrees, "new")
        .map_triplets(F.lit(1.0) / F.col("src_attr"), ends=("src",))
        .map_vertices(F.lit(1.0 / max(ready.counts["vertices"], 1)))
    )


def _rounds(ready: PreparedGraph, num_iter: int, damping: float, observer) -> DataFrame:
    """One job per round: it moves the messages, updates the ranks, and observes
    the dangling mass that the next round spreads."""
    workspace = Workspace(ready.spark, "pagerank")
    total = ready.counts["vertices"]
    first = F.lit(1.0 / max(total, 1))
    state = Table(ready.vertices.select("id", first.alias("value"), "out_degree"), "")
    bucketed = observer is None and num_iter > 0 and ready.outgoing.joins_states
    if bucketed:
        state = workspace.write_bucketed("start", state.df, "id", ready.outgoing.parts)
    recent = Recent(workspace)
    recent.add(state)
    dangling = ready.counts["dangling"] / max(total, 1)
    nothing = F.lit(None).cast("double")
    for number in range(num_iter):
        started = time.perf_counter_ns()
        senders = state.df.filter("out_degree > 0").select(
            "id", (F.col("value") / F.col("out_degree")).alias("part")
        )
        sent = ready.outgoing.meet(senders).select(
            F.col("dst").alias("id"), "part", F.lit(None).cast("bigint").alias("out_degree")
        )
        received = F.coalesce(F.sum("part"), F.lit(0.0))
        rank = (1 - damping) / total + damping * (received + dangling / total)
        without_edges = F.when(F.col("out_degree") == 0, F.col("value"))
        spread = F.coalesce(F.sum(without_edges), F.lit(0.0))
        if bucketed:
            # ranks stay in the buckets of their senders; only messages move
            ranks = sent.groupBy("id").agg(rank.alias("rank"))
            updated = state.df.select("id", "out_degree").join(ranks.hint("shuffle_hash"), "id", "left").select(
                "id",
                F.coalesce("rank", F.lit((1 - damping) / total + damping * (dangling / total))).alias("value"),
                "out_degree",
            )
            metrics = {}
            following = workspace.write_bucketed(
                f"round={number}", updated, "id", ready.outgoing.parts, placed=True, dangling=spread
            )
        else:
            updated = (
                state.df.select("id", nothing.alias("part"), "out_degree")
                .unionByName(sent)
                .groupBy("id")
                .agg(rank.alias("value"), F.max("out_degree").alias("out_degree"))
            )
            following, metrics = write_round(
                workspace, f"round={number}", updated, number, observer, dangling=spread
            )
        dangling = following.observed["dangling"]
        if observer is not None:
            elapsed = time.perf_counter_ns() - started
            observer(Round(number, following.df, None, None, elapsed, metrics))
        state = recent.add(following)
    if observer is not None:
        observer.finish()
    recent.keep_last()
    if bucketed:
        state = workspace.plain(state)
    ranks = state.df.select("id", F.col("value").alias("attr"))
    return ranks if state.path else workspace.write("ranks", ranks).df
