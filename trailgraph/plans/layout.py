"""Edges placed once so that no round has to move them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailgraph.plans import skew
from trailgraph.workspace import Table, Workspace

EDGES_PER_PARTITION = 4_000_000
SMALL_EDGES_PER_PARTITION = 50_000
#: Vertices above which a state is kept in buckets; fewer are moved in less time
#: than a table in the catalog takes.
BUCKETED_STATE_ROWS = 100_000


def vertex_table(workspace: Workspace, vertices: DataFrame, edges: DataFrame) -> Table:
    """``(id, out_degree, in_degree)`` for all vertices and edge endpoints.

    One job: it also observes the counts every algorithm needs (vertices,
    edges, dangling vertices, largest degrees).
    """
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    ends = (
        edges.select(F.col("src").alias("id"), one.alias("out_degree"), zero.alias("in_degree"))
        .unionByName(
            edges.select(
                F.col("dst").alias("id"), zero.alias("out_degree"), one.alias("in_degree")
            )
        )
        .unionByName(
            vertices.select("id", zero.alias("out_degree"), zero.alias("in_degree"))
        )
    )
    degrees = ends.groupBy("id").agg(
        F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree")
    )
    return workspace.write(
        "vertices",
        degrees,
        vertices=F.count(F.lit(1)),
        smallest_id=F.min("id"),
        edges=F.coalesce(F.sum("out_degree"), zero),
        dangling=F.count_if(F.col("out_degree") == 0),
        nulls=F.count_if(F.col("id").isNull()),
        max_out=F.coalesce(F.max("out_degree"), zero),
        max_in=F.coalesce(F.max("in_degree"), zero),
        max_degree=F.coalesce(F.max(F.col("out_degree") + F.col("in_degree")), zero),
    )


def partitions_for(spark, rows: int) -> int:
    """Partitions for ``rows`` edges: few for a small graph, and never so few
    that one of them outgrows an executor's memory."""
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(session, -(-rows // SMALL_EDGES_PER_PARTITION))
    return max(1, wanted, -(-rows // EDGES_PER_PARTITION))


class EdgeLayout:
    """Edges bucketed and sorted by sender, in a table on shared storage.

    A round joins its senders to them without moving or sorting an edge, and
    losing an executor loses none.  The out-edges of a hot sender, copies
    included, are dealt out over all partitions instead, and meet that sender's
    value by broadcast.
    """

    def __init__(self, workspace: Workspace, name: str, edges: DataFrame, degrees: DataFrame,
                 total: int, largest: int, min_hot_rows: int | None = None, joins_states: bool = False):
        """``degrees`` is ``(id, degree)`` of the senders of ``edges``;
        ``joins_states`` says that states are to be bucketed like the edges and
        joined with their messages: all vertices have ids, and they are many."""
        spark = edges.sparkSession
        self.total = total
        self.joins_states = joins_states
        self.workspace = workspace
        parts = partitions_for(spark, total)
        limit = skew.threshold(total, min_hot_rows)
        self.hot_ids = self.hot = self._hot_table = None
        cold = edges
        if largest > limit:
            self.hot_ids = degrees.filter(F.col("degree") > limit).select(
                F.col("id").alias("hot_id")
            )
            keys = F.broadcast(self.hot_ids)
            is_hot = F.col("src") == F.col("hot_id")
            cold = edges.join(keys, is_hot, "left_anti")
            self._hot_table = workspace.write(
                f"{name}-hot", edges.join(keys, is_hot, "left_semi").repartition(parts)
            )
            self.hot = self._hot_table.df
        self.parts = parts
        self._cold_table = workspace.write_bucketed(name, cold, "src", parts)
        self.cold = self._cold_table.df

    def meet(self, senders: DataFrame) -> DataFrame:
        """Join the sending vertices ``(id, ...)`` with their out-edges.

        Each task holds the senders of its bucket, which are no more than its
        edges, so the edges need no order.
        """
        on = F.col("src") == F.col("id")
        met = self.cold.join(senders.hint("shuffle_hash"), on).drop("id")
        if self.hot is None:
            return met
        hot_senders = senders.join(
            F.broadcast(self.hot_ids), F.col("id") == F.col("hot_id"), "left_semi"
        )
        return met.unionByName(self.hot.join(F.broadcast(hot_senders), on).drop("id"))

    def meet_few(self, senders: DataFrame, ids: list[int] | None = None) -> DataFrame:
        """The same for senders that are known to be few, so that they may be
        broadcast; with their ``ids``, only the buckets of those are read."""
        edges = self.cold if self.hot is None else self.cold.unionByName(self.hot)
        if ids is not None:
            edges = edges.filter(F.col("src").isin(ids))
        return edges.join(F.broadcast(senders), F.col("src") == F.col("id")).drop("id")

    def release(self) -> None:
        self.workspace.drop(self._cold_table)
        self.workspace.drop(self._hot_table)
