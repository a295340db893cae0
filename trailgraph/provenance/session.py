"""A provenance session: traced operations, capture and run metadata.

The session keeps one small record per operation on the driver, as a query
history does, and hands them out as tables.  The traced data stays in
DataFrames; tracing by itself runs no job.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession

from trailgraph.graph import PropertyGraph
from trailgraph.operators.joins import restrict_vertices
from trailgraph.operators.transform import subgraph
from trailgraph.provenance import tables
from trailgraph.provenance.events import OPERATION, Event
from trailgraph.sinks.snapshots import COMMITS, EDGES, StorageFormat, write_edges, write_snapshot

# Operations whose result is being released, never stored.
RELEASING_OPERATIONS = ("unpersist", "unpersistVertices")

NOT_STORED = ""


@dataclass(frozen=True)
class ProvEdge:
    seq: int
    source: int
    target: int
    event: Event


@dataclass(frozen=True)
class ProvNode:
    """A graph as the session knows it: metrics are the last value of each name."""

    id: int
    location: str | None
    metrics: dict


@dataclass(frozen=True)
class GraphPredicate:
    """Store the subgraph of vertices and edges that pass."""

    vertex: Column | str | None = None
    edge: Column | str | None = None


@dataclass(frozen=True)
class DeltaPredicate:
    """Store the given vertices as they were before the operation."""

    ids: DataFrame


@dataclass(frozen=True)
class CaptureFilter:
    """Which graphs to store (``edge`` and ``node`` see provenance records, and
    ``record`` the location and the metrics of a node so far) and which part of
    them (``data``).  With ``edges``, the edges of that part are stored too; a
    delta has none."""

    edge: Callable[[ProvEdge], bool] = lambda _: True
    node: Callable[[int], bool] = lambda _: True
    data: GraphPredicate | DeltaPredicate = field(default_factory=GraphPredicate)
    record: Callable[[ProvNode], bool] | None = None
    edges: bool = False


@dataclass(frozen=True)
class Hook:
    """Metrics of the user's own at chosen events.

    ``pre`` sees the graph before the operation and ``post`` the one after it;
    each returns metric name to value, and runs what jobs it needs.

    ``observe`` names aggregates over the vertices ``(id, attr)`` after the event.
    They are taken by the job that writes these vertices anyway, the round of an
    algorithm, so they run no job of their own; events that write nothing give none.
    """

    event: Callable[[Event], bool] = lambda _: True
    pre: Callable[[PropertyGraph], dict] | None = None
    post: Callable[[PropertyGraph], dict] | None = None
    observe: dict[str, Column] = field(default_factory=dict)


class ProvenanceSession:
    def __init__(
        self,
        spark: SparkSession,
        tracing: bool = True,
        storage: bool = False,
        capture: CaptureFilter | None = None,
        directory: str | None = None,
        storage_format: StorageFormat | str = "ParquetFile()",
        hooks: tuple[Hook, ...] = (),
        run_id: str | None = None,
    ):
        if storage and directory is None:
            raise ValueError("storing snapshots needs a directory")
        self.spark = spark
        self.tracing = tracing
        self.storage = storage and tracing
        self.capture = capture
        self.directory = directory
        self.format = StorageFormat.parse(storage_format)
        self.hooks = hooks
        self.run_id = run_id or uuid.uuid4().hex
        self.edges: list[ProvEdge] = []
        self.metrics: list[tuple] = []
        self.locations: dict[int, str] = {}
        self.captured: dict[int, tuple[Event, str]] = {}
        self.captured_edges: dict[int, str] = {}
        self._nodes = 0
        self._seen: Counter = Counter()
        self._pool: ThreadPoolExecutor | None = None
        self._writes: list[Future] = []

    # graphs and edges

    def adopt(self, graph: PropertyGraph) -> PropertyGraph:
        """``graph`` as a node of this session."""
        if graph.session is self and graph.node_id is not None:
            return graph
        node_id = self._nodes
        self._nodes += 1
        return replace(graph, session=self, node_id=node_id)

    def add(self, source: PropertyGraph, target: PropertyGraph, event: Event) -> ProvEdge:
        edge = ProvEdge(len(self.edges), source.node_id, target.node_id, event)
        self.edges.append(edge)
        return edge

    def trace(
        self,
        source: PropertyGraph,
        event: Event,
        operation: Callable[[], PropertyGraph],
        nanos: int | None = None,
        background: bool = False,
    ) -> PropertyGraph:
        """Run ``operation`` and record that its result came from ``source``.

        ``nanos`` is the time of the work behind the result when that was done
        beforehand, as in the rounds of an algorithm.  With ``background``, a
        snapshot is written by a job of its own beside what follows; the graphs
        it reads must stay until ``flush``.
        """
        if not self.tracing:
            return operation()
        hooks = [hook for hook in self.hooks if hook.event(event)]
        for hook in hooks:
            if hook.pre is not None:
                self._gauges(source.node_id, hook.pre(source))
        started = time.perf_counter_ns()
        result = self.adopt(operation())
        if nanos is None:
            nanos = time.perf_counter_ns() - started
        for hook in hooks:
            if hook.post is not None:
                self._gauges(result.node_id, hook.post(result))
        edge = self.add(source, result, event)
        self._measured("edge", edge.seq, "time", "operationTime", int(nanos), "ns")
        self._capture(source, result, edge, background)
        return result

    def _gauges(self, node_id: int, values: dict) -> None:
        for name, value in values.items():
            self.gauge(node_id, name, value)

    def observed(self, candidates: list[Event]) -> dict[str, Column]:
        """What hooks want observed of vertices that any of these events gives."""
        return {
            f"hook {number} {name}": metric
            for number, hook in enumerate(self.hooks)
            if any(hook.event(event) for event in candidates)
            for name, metric in hook.observe.items()
        }

    def record_observed(self, node_id: int, values: dict) -> None:
        """Gauges of what was observed under the names that ``observed`` gave."""
        self._gauges(node_id, {key.split(" ", 2)[2]: value for key, value in values.items()})

    def gauge(self, node_id: int, name: str, value) -> None:
        """A number of any size, a truth value or a text; None is not recorded."""
        if value is not None:
            self._measured("node", node_id, "gauge", name, value, None)

    def counter(self, node_id: int, name: str, value: int) -> None:
        self._measured("node", node_id, "counter", name, value, None)

    def _measured(self, owner: str, owner_id: int, kind: str, name: str, value, unit) -> None:
        """One metric, its value in the columns of its type."""
        text = exact = None
        if isinstance(value, bool):
            value = str(value).lower()
        if isinstance(value, (int, Decimal)):
            exact, value = Decimal(value), float(value)
            if exact != exact.to_integral_value() or abs(exact) >= 10**38:
                exact = None
        elif not isinstance(value, float):
            text, value = str(value), None
        self.metrics.append((owner, owner_id, kind, name, value, unit, exact, text))

    def node(self, node_id: int) -> ProvNode:
        """What is recorded of a graph by now."""
        found = {
            name: next(v for v in (text, exact, value) if v is not None)
            for owner, of, _, name, value, _, exact, text in self.metrics
            if owner == "node" and of == node_id
        }
        return ProvNode(node_id, self.locations.get(node_id), found)

    # capture

    def should_capture(self, edge: ProvEdge) -> bool:
        """Whether this newest edge makes its target a stored graph.

        Only the new edge is tested: the target must have no location yet, and
        this must be the one edge into it that carries the event and passes.
        """
        rule = self.capture
        if rule is None or not rule.edge(edge):
            return False
        if not (rule.node(edge.source) and rule.node(edge.target)):
            return False
        if rule.record is not None:
            if not all(rule.record(self.node(end)) for end in (edge.source, edge.target)):
                return False
        self._seen[edge.target, edge.event] += 1
        if edge.target in self.locations or self._seen[edge.target, edge.event] != 1:
            return False
        event = edge.event
        return not (event.event_type == OPERATION and event.event_name in RELEASING_OPERATIONS)

    def _capture(
        self, source: PropertyGraph, result: PropertyGraph, edge: ProvEdge, background: bool
    ) -> None:
        if not self.should_capture(edge):
            return
        node = result.node_id
        if not self.storage:
            self.locations[node] = NOT_STORED
            return
        rule, edges = self.capture.data, None
        if isinstance(rule, DeltaPredicate):
            vertices = restrict_vertices(source.vertices, rule.ids)
        else:
            vertices, edges = subgraph(result.vertices, result.edges, rule.vertex, rule.edge)
        edges = edges if self.capture.edges else None
        if edges is not None:
            kind = edges.schema["attr"].dataType.simpleString() if "attr" in edges.columns else "string"
            self.captured_edges[node] = kind
        path = f"{self.directory}/run_id={self.run_id}/node_id={node}"
        self.locations[node] = path
        value_type = "string"
        if "attr" in vertices.columns:
            value_type = vertices.schema["attr"].dataType.simpleString()
        self.captured[node] = (edge.event, value_type)
        if background:
            self._writes.append(self._writer().submit(self._store, vertices, edges, path, node))
        else:
            self._store(vertices, edges, path, node)

    def edge_path(self, node: int) -> str:
        return f"{self.directory}/{EDGES}/run_id={self.run_id}/node_id={node}"

    def _store(self, vertices: DataFrame, edges: DataFrame | None, path: str, node: int) -> None:
        """Both tables of a snapshot, and then the marker that says that it is whole."""
        started = time.perf_counter_ns()
        write_snapshot(vertices, path, self.format)
        if edges is not None:
            write_edges(edges, self.edge_path(node), self.format)
            marker = self.spark.createDataFrame([(self.format.name, True)], "storage_format string, with_edges boolean")
            marker.coalesce(1).write.parquet(
                f"{self.directory}/{COMMITS}/run_id={self.run_id}/node_id={node}"
            )
        nanos = time.perf_counter_ns() - started
        self._measured("node", node, "time", "storageTime", nanos, "ns")

    def _writer(self) -> ThreadPoolExecutor:
        if self._pool is None:
            self._pool = ThreadPoolExecutor(max_workers=1)
        return self._pool

    def flush(self) -> None:
        """Wait for the snapshots being written; raises what went wrong.  The
        thread that writes them ends; the next snapshot starts another."""
        try:
            while self._writes:
                self._writes.pop(0).result()
        finally:
            if self._pool is not None and not self._writes:
                self._pool.shutdown(wait=False)
                self._pool = None

    # tables; they wait for the snapshots still being written

    def prov_nodes(self) -> DataFrame:
        """Nodes of the provenance graph: the endpoints of its edges."""
        ids = sorted({e.source for e in self.edges} | {e.target for e in self.edges})
        rows = [(self.run_id, i, self.locations.get(i)) for i in ids]
        return self.spark.createDataFrame(rows, tables.PROV_NODES)

    def prov_edges(self) -> DataFrame:
        rows = [
            (
                self.run_id,
                e.seq,
                e.source,
                e.target,
                e.event.event_type,
                e.event.event_name,
                dict(e.event.params),
            )
            for e in self.edges
        ]
        return self.spark.createDataFrame(rows, tables.PROV_EDGES)

    def prov_metrics(self) -> DataFrame:
        self.flush()
        rows = [(self.run_id, *metric) for metric in self.metrics]
        return self.spark.createDataFrame(rows, tables.PROV_METRICS)

    def stored(self) -> dict[int, str]:
        """Node id to location of the snapshots that were written."""
        self.flush()
        return {node: path for node, path in self.locations.items() if path}

    def snapshot_edges(self) -> DataFrame:
        """The stored edges: ``(run_id, node_id, src, dst, value)``."""
        self.flush()
        return tables.read_snapshot_edges(self)

    def save(self, path: str) -> None:
        """Add this run to the provenance tables below ``path``; again replaces it."""
        for name, rows in (("nodes", self.prov_nodes()), ("edges", self.prov_edges()), ("metrics", self.prov_metrics())):
            tables.append_runs(rows, f"{path}/{name}")

    def snapshots(self) -> DataFrame:
        """All stored snapshots: ``(run_id, node_id, event_name, iteration, id, value)``."""
        self.flush()
        return tables.read_snapshots(self)
