"""Property graphs as a vertex and an edge DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from trailgraph.operators import aggregate, joins, transform
from trailgraph.operators.triplets import BOTH_ENDS, triplets
from trailgraph.provenance import events
from trailgraph.workspace import Workspace

if TYPE_CHECKING:
    from trailgraph.provenance.session import ProvenanceSession


@dataclass(frozen=True)
class PropertyGraph:
    """A directed multigraph.

    ``vertices`` is ``(id LONG[, attr])`` with one row per vertex, ``edges`` is
    ``(src LONG, dst LONG[, attr])``.  Graphs are immutable; every operator
    returns a new one.  With a provenance session attached, every operator also
    records which graph it came from.

    ``listed`` is set where ``vertices`` is computed as these rows plus the edge
    endpoints, so that a job that reads the edges anyway need not do it twice.
    ``edges_stored`` says that ``edges`` is a plain scan of a columnar table, so
    that algorithms read it as it is and do not write one first.
    """

    vertices: DataFrame
    edges: DataFrame
    session: ProvenanceSession | None = None
    node_id: int | None = None
    listed: DataFrame | None = None
    edges_stored: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None) -> PropertyGraph:
        """A graph whose vertices are the given ones and all edge endpoints, one
        row per id; endpoints without a row get a NULL attribute, and an id with
        several rows the smallest of their attributes (any, if they have no order)."""
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        listed = edges.sparkSession.range(0) if vertices is None else vertices
        if vertices is None or "attr" not in vertices.columns:
            return PropertyGraph(ids.union(listed.select("id")).distinct(), edges, listed=listed)
        kind = vertices.schema["attr"].dataType
        chosen = F.any_value("attr", F.lit(True)) if isinstance(kind, (MapType, VariantType)) else F.min("attr")
        rows = ids.withColumn("attr", F.lit(None).cast(kind)).unionByName(vertices.select("id", "attr"))
        return PropertyGraph(rows.groupBy("id").agg(chosen.alias("attr")), edges, listed=listed)

    def stored(self) -> PropertyGraph:
        """The same graph with its edges and vertices in working tables, for a
        graph that is costly to compute and read more than once."""
        workspace = Workspace(self.edges.sparkSession, "graph")
        edges = workspace.write("edges", self.edges).df
        vertices = self.vertices
        if self.listed is not None:
            vertices = PropertyGraph.from_edges(edges, self.listed).vertices
        return replace(
            self,
            edges=edges,
            vertices=workspace.write("vertices", vertices).df,
            listed=None,
            edges_stored=True,
        )

    @property
    def vertex_rows(self) -> DataFrame:
        """Rows that, with the edge endpoints, make up the vertices."""
        return self.vertices if self.listed is None else self.listed

    def with_session(self, session: ProvenanceSession) -> PropertyGraph:
        """The same graph, traced by ``session`` from here on."""
        return session.adopt(self)

    def derive(self, vertices: DataFrame | None = None, edges: DataFrame | None = None):
        """A new graph in the same session, not yet a provenance node."""
        return replace(
            self,
            vertices=self.vertices if vertices is None else vertices,
            edges=self.edges if edges is None else edges,
            node_id=None,
            listed=None,
            edges_stored=self.edges_stored and edges is None,
        )

    def trace(self, event: events.Event, operation: Callable[[], PropertyGraph]) -> PropertyGraph:
        if self.session is None:
            return operation()
        return self.session.trace(self, event, operation)

    def _operation(self, name: str, build: Callable[[], dict]) -> PropertyGraph:
        return self.trace(events.operation(name), lambda: self.derive(**build()))

    # projections and filters

    def triplets(self, ends: Iterable[str] = BOTH_ENDS) -> DataFrame:
        return triplets(self.vertices, self.edges, ends)

    def map_vertices(self, expression: Column | str) -> PropertyGraph:
        return self._operation(
            "mapVertices",
            lambda: {"vertices": transform.map_vertices(self.vertices, expression)},
        )

    def map_edges(self, expression: Column | str) -> PropertyGraph:
        return self._operation(
            "mapEdges", lambda: {"edges": transform.map_edges(self.edges, expression)}
        )

    def map_triplets(
        self, expression: Column | str, ends: Iterable[str] = BOTH_ENDS
    ) -> PropertyGraph:
        return self._operation(
            "mapTriplets",
            lambda: {
                "edges": transform.map_triplets(self.vertices, self.edges, expression, ends)
            },
        )

    def remove_self_edges(self) -> PropertyGraph:
        return self._operation(
            "removeSelfEdges", lambda: {"edges": transform.remove_self_edges(self.edges)}
        )

    def canonical_edges(self, merge: Callable[[Column], Column] = F.min) -> PropertyGraph:
        return self._operation(
            "convertToCanonicalEdges",
            lambda: {"edges": aggregate.canonical_edges(self.edges, merge)},
        )

    def subgraph(
        self,
        vertex_predicate: Column | str | None = None,
        edge_predicate: Column | str | None = None,
        ends: Iterable[str] = BOTH_ENDS,
    ) -> PropertyGraph:
        vertices, edges = transform.subgraph(
            self.vertices, self.edges, vertex_predicate, edge_predicate, ends
        )
        return self.derive(vertices=vertices, edges=edges)

    # joins

    def join_vertices(self, table: DataFrame, expression: Column | str) -> PropertyGraph:
        return self._operation(
            "joinVertices",
            lambda: {"vertices": joins.join_vertices(self.vertices, table, expression)},
        )

    def outer_join_vertices(self, table: DataFrame, expression: Column | str) -> PropertyGraph:
        return self._operation(
            "outerJoinVertices",
            lambda: {"vertices": joins.outer_join_vertices(self.vertices, table, expression)},
        )

    def vertices_minus(self, other: DataFrame) -> DataFrame:
        return joins.vertices_minus(self.vertices, other)

    def inner_join_vertices(self, other: DataFrame, expression: Column | str = "attr") -> DataFrame:
        return joins.inner_join_vertices(self.vertices, other, expression)

    def restrict_vertices(self, ids: DataFrame) -> PropertyGraph:
        """Only the vertices in ``ids``, with all edges kept."""
        return self.derive(vertices=joins.restrict_vertices(self.vertices, ids))

    # aggregations

    def num_vertices(self) -> int:
        return self.vertices.count()

    def out_degrees(self) -> DataFrame:
        return aggregate.out_degrees(self.edges)

    def aggregate_messages(
        self,
        sends: Iterable[aggregate.Send],
        merge: Callable[[Column], Column] | aggregate.Merge,
        ends: Iterable[str] = BOTH_ENDS,
    ) -> DataFrame:
        return aggregate.aggregate_messages(self.vertices, self.edges, sends, merge, ends)

    def collect_edges(self, direction: str, part_ids: int = aggregate.PART_IDS) -> DataFrame:
        return aggregate.collect_edges(self.edges, direction, part_ids)

    def collect_neighbors(self, direction: str, part_ids: int = aggregate.PART_IDS) -> DataFrame:
        return aggregate.collect_neighbors(self.vertices, self.edges, direction, part_ids)

    # algorithms

    def pregel(self, *args, **kwargs) -> PropertyGraph:
        from trailgraph.algorithms.pregel import pregel

        return pregel(self, *args, **kwargs)

    def bfs(self, source: int, **kwargs) -> PropertyGraph:
        from trailgraph.algorithms.traversal import bfs

        return bfs(self, source, **kwargs)

    def sssp(self, source: int, **kwargs) -> PropertyGraph:
        from trailgraph.algorithms.traversal import sssp

        return sssp(self, source, **kwargs)

    def wcc(self, max_iter: int | None = None, **kwargs) -> PropertyGraph:
        from trailgraph.algorithms.components import wcc

        return wcc(self, max_iter, **kwargs)

    def pagerank(self, num_iter: int, damping: float = 0.85, **kwargs) -> PropertyGraph:
        from trailgraph.algorithms.pagerank import pagerank

        return pagerank(self, num_iter, damping, **kwargs)

    def cdlp(self, max_iter: int, **kwargs) -> PropertyGraph:
        from trailgraph.algorithms.communities import cdlp

        return cdlp(self, max_iter, **kwargs)

    def lcc(self, **kwargs) -> PropertyGraph:
        from trailgraph.algorithms.clustering import lcc

        return lcc(self, **kwargs)
