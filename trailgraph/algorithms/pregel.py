"""Message passing with a vertex program of the user's own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.algorithms.common import RoundRecorder, is_traced, preparation
from trailgraph.graph import PropertyGraph
from trailgraph.operators.aggregate import Merge, Send, merged, sent_messages
from trailgraph.operators.triplets import BOTH_ENDS
from trailgraph.plans import skew
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.plans.rounds import Recent, Round, write_round
from trailgraph.provenance import events
from trailgraph.workspace import Table, Workspace


def pregel(
    graph: PropertyGraph,
    initial: Column,
    program: Callable[[Column, Column, Column], Column],
    sends: Iterable[Send],
    merge: Callable[[Column], Column] | Merge,
    max_iter: int | None = None,
    ends: Iterable[str] = BOTH_ENDS,
    prepared: PreparedGraph | None = None,
) -> PropertyGraph:
    """Rounds of messages until none is sent or ``max_iter`` rounds are done.

    ``program(id, attr, message)`` gives a vertex its new attribute; it is first
    applied to every vertex with the ``initial`` message, then to the vertices
    that received one.  ``sends`` are evaluated on all triplets, with the
    attributes of the given ``ends``; ``merge`` is an aggregate or a ``Merge``.
    """
    if max_iter is not None and max_iter <= 0:
        raise ValueError(f"the number of iterations must be above 0, got {max_iter}")
    sends, ends = list(sends), tuple(ends)
    first_value = program(F.col("id"), F.col("attr"), initial)
    with preparation(graph, prepared) as ready:
        vertices = _with_attributes(graph, ready)
        start = vertices.select("id", first_value.alias("attr"))

        def run(recorder) -> DataFrame:
            return _rounds(ready, start, program, sends, merge, max_iter, ends, recorder)

        if not is_traced(graph):
            return graph.derive(vertices=run(None))
        session = graph.session

        def rounds() -> PropertyGraph:
            first = replace(graph, vertices=vertices).map_vertices(first_value)
            session.add(graph, first, events.pregel_start())
            recorder = RoundRecorder(first)
            final = run(recorder)
            return replace(recorder.graph, vertices=final)

        return session.trace(graph, events.pregel(), rounds)


def _with_attributes(graph: PropertyGraph, ready: PreparedGraph) -> DataFrame:
    """All vertices, endpoints included, with the attribute they have, if any."""
    known = graph.vertex_rows
    if "attr" not in known.columns:
        return ready.vertices.select("id", F.lit(None).cast("string").alias("attr"))
    return ready.vertices.select("id").join(known.select("id", "attr"), "id", "left")


def _view(ready: PreparedGraph, state: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """Triplets over the layout, with hubs kept in place at both ends."""
    if "src" in ends:
        view = ready.outgoing.meet(state.select("id", F.col("attr").alias("src_attr")))
    else:
        view = ready.edges
    if "dst" in ends:
        limit = skew.threshold(ready.counts["edges"], ready.min_hot_rows)
        hot = None
        if ready.counts["max_in"] > limit:
            hot = ready.vertices.filter(F.col("in_degree") > limit).select(
                F.col("id").alias("hot_id")
            )
        table = state.select("id", F.col("attr").alias("dst_attr"))
        view = skew.lookup(view, "dst", table, "id", hot).drop("id")
    return view


def _rounds(ready, start, program, sends, merge, max_iter, ends, observer) -> DataFrame:
    """One job per round.  A round's table holds each vertex with its attribute
    and the message it got for the next round, NULL for none."""
    workspace = Workspace(ready.spark, "pregel")

    def with_messages(name: str, state: DataFrame, number: int, watcher) -> tuple[Table, dict]:
        messages = (
            merged(sent_messages(_view(ready, state, ends), sends), merge)
            .withColumnRenamed("id", "receiver")
        )
        received = F.col("receiver").isNotNull()
        table = state.join(messages, F.col("id") == F.col("receiver"), "left").select(
            "id", "attr", received.alias("received"), "msg"
        )
        active = F.count_if(F.col("received"))
        return write_round(workspace, name, table, number, watcher, "attr", active=active)

    recent = Recent(workspace)
    current = recent.add(with_messages("start", start, 0, None)[0])
    number = 0
    while current.observed["active"] > 0 and (max_iter is None or number < max_iter):
        started = time.perf_counter_ns()
        updated = program(F.col("id"), F.col("attr"), F.col("msg"))
        state = current.df.select(
            "id", F.when(F.col("received"), updated).otherwise(F.col("attr")).alias("attr")
        )
        following, metrics = with_messages(f"round={number}", state, number, observer)
        if observer is not None:
            shown = following.df.select("id", F.col("attr").alias("value"))
            elapsed = time.perf_counter_ns() - started
            observer(
                Round(number, shown, current.observed["active"], following.observed["active"],
                      elapsed, metrics)
            )
        current = recent.add(following)
        number += 1
    if observer is not None:
        observer.finish()
    recent.keep_last()
    return current.df.select("id", "attr")
