"""What the iterative algorithms share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.graph import PropertyGraph
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.plans.rounds import Round
from trailgraph.provenance import events


@contextmanager
def preparation(graph: PropertyGraph, prepared: PreparedGraph | None) -> Iterator[PreparedGraph]:
    """The caller's prepared graph, or one that lives as long as the algorithm."""
    if prepared is not None:
        yield prepared
        return
    own = PreparedGraph(graph)
    try:
        yield own
    finally:
        own.release()


class RoundRecorder:
    """Writes the rounds of an algorithm to the provenance session: for each,
    the vertex update inside the iteration event.

    The snapshot of a round is written while the round after the next runs.
    """

    def __init__(self, graph: PropertyGraph, operation: str = "joinVertices"):
        self.graph = graph
        self.operation = operation

    def _events(self, number: int) -> list[events.Event]:
        return [events.operation(self.operation), events.pregel_iteration(number)]

    def wanted(self, number: int) -> dict[str, Column]:
        return self.graph.session.observed(self._events(number))

    def __call__(self, finished: Round) -> None:
        session = self.graph.session
        session.flush()
        source = self.graph
        vertices = finished.state.select("id", F.col("value").alias("attr"))

        def update() -> PropertyGraph:
            return session.trace(
                source,
                events.operation(self.operation),
                lambda: source.derive(vertices=vertices),
                nanos=finished.nanos,
                background=True,
            )

        self.graph = session.trace(
            source,
            events.pregel_iteration(finished.number),
            update,
            nanos=finished.nanos,
            background=True,
        )
        session.counter(self.graph.node_id, "iteration", finished.number)
        if finished.next_changed is not None:
            session.gauge(self.graph.node_id, "activeMessages", finished.next_changed)
        session.record_observed(self.graph.node_id, finished.metrics)

    def finish(self) -> None:
        self.graph.session.flush()


def is_traced(graph: PropertyGraph) -> bool:
    return graph.session is not None and graph.session.tracing


def message_passing(
    graph: PropertyGraph,
    event: events.Event,
    setup: Callable[[PropertyGraph], PropertyGraph],
    run: Callable[[RoundRecorder | None], DataFrame],
) -> PropertyGraph:
    """A message-passing algorithm with the events it leaves behind.

    ``setup`` derives the start graph from ``graph``; ``run`` does the rounds,
    handing each to the recorder, and returns the final vertices.
    """
    if not is_traced(graph):
        return setup(graph).derive(vertices=run(None))
    session = graph.session

    def algorithm() -> PropertyGraph:
        start = setup(graph)

        def rounds() -> PropertyGraph:
            # The initial message changes no value, but gives a graph of its own.
            first = start.map_vertices("attr")
            session.add(start, first, events.pregel_start())
            recorder = RoundRecorder(first)
            vertices = run(recorder)
            return replace(recorder.graph, vertices=vertices)

        return session.trace(start, events.pregel(), rounds)

    return session.trace(graph, event, algorithm)
