"""A graph made ready for iteration: vertex table plus edge layouts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from trailgraph.plans import layout as layouts, skew
from trailgraph.plans.layout import EdgeLayout, vertex_table
from trailgraph.workspace import Workspace


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; a reciprocal pair gives four rows."""
    columns = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns)
    )


class PreparedGraph:
    """Vertex table and edge layouts of one graph, each made on first use.

    Unless the graph says that its edges are stored, they are written first, so
    that an edge view that is costly to compute (text, joins, aggregates) is
    computed once.
    """

    def __init__(self, graph, min_hot_rows: int | None = None):
        self.graph = graph
        self.spark = graph.edges.sparkSession
        self.workspace = Workspace(self.spark, "prepared")
        self.min_hot_rows = min_hot_rows
        self._layouts: list[EdgeLayout] = []

    @cached_property
    def edges(self) -> DataFrame:
        if self.graph.edges_stored:
            return self.graph.edges
        return self.workspace.write("edges", self.graph.edges).df

    @cached_property
    def vertex_stats(self):
        return vertex_table(self.workspace, self.graph.vertex_rows, self.edges)

    @property
    def vertices(self) -> DataFrame:
        return self.vertex_stats.df

    @property
    def counts(self) -> dict:
        return self.vertex_stats.observed

    def _layout(self, name: str, edges: DataFrame, degree, total: int, largest: int) -> EdgeLayout:
        degrees = self.vertices.select("id", degree.alias("degree"))
        joins_states = not self.counts["nulls"] and self.counts["vertices"] > layouts.BUCKETED_STATE_ROWS
        layout = EdgeLayout(
            self.workspace, name, edges, degrees, total, largest, self.min_hot_rows, joins_states
        )
        self._layouts.append(layout)
        return layout

    @cached_property
    def outgoing(self) -> EdgeLayout:
        """Edges as written, by source."""
        return self._layout(
            "outgoing", self.edges, F.col("out_degree"), self.counts["edges"], self.counts["max_out"]
        )

    @cached_property
    def both_ways(self) -> EdgeLayout:
        """Edges in both directions with the number of parallel copies ``n``."""
        pairs = (
            symmetric(self.edges.select("src", "dst"))
            .groupBy("src", "dst")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        degree = F.col("out_degree") + F.col("in_degree")
        total, largest = 2 * self.counts["edges"], self.counts["max_degree"]
        if largest > skew.threshold(total, self.min_hot_rows):
            # Read for the hubs and for the rest: count the pairs once.
            pairs = self.workspace.write("pairs", pairs).df
        return self._layout("both-ways", pairs, degree, total, largest)

    def release(self) -> None:
        """Free the layouts and delete the working tables."""
        for layout in self._layouts:
            layout.release()
        self.workspace.clear()
