"""Local clustering coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.algorithms.common import preparation
from trailgraph.graph import PropertyGraph
from trailgraph.plans import skew
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.provenance import events
from trailgraph.workspace import Workspace

# Candidates one slot of a vertex may meet before it is split further.
CANDIDATES_PER_SLOT = 10_000_000


def lcc(
    graph: PropertyGraph,
    prepared: PreparedGraph | None = None,
    candidates_per_slot: int = CANDIDATES_PER_SLOT,
) -> PropertyGraph:
    """Directed edges among the neighbours of a vertex, over ``n * (n - 1)`` for
    its ``n`` neighbours in either direction; 0 for fewer than two.

    Self-loops do not count.
    """

    def run() -> PropertyGraph:
        with preparation(graph, prepared) as ready:
            return graph.derive(vertices=_coefficients(ready, candidates_per_slot))

    return graph.trace(events.algorithm("LCC"), run)


def _coefficients(ready: PreparedGraph, candidates_per_slot: int) -> DataFrame:
    workspace = Workspace(ready.spark, "lcc")
    pairs = workspace.write(
        "pairs",
        ready.edges.filter("src <> dst")
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.count(F.lit(1)).alias("w")),
        pairs=F.count(F.lit(1)),
    )
    ends = pairs.df.select(F.col("a").alias("v")).unionAll(pairs.df.select("b"))
    neighbours = workspace.write(
        "neighbours",
        ends.groupBy("v").agg(F.count(F.lit(1)).alias("n")),
        largest=F.coalesce(F.max("n"), F.lit(0)),
    )
    hot = None
    limit = skew.threshold(pairs.observed["pairs"], ready.min_hot_rows)
    if neighbours.observed["largest"] > limit:
        hot = neighbours.df.filter(F.col("n") > limit).select(F.col("v").alias("hot_id"))

    oriented = workspace.write("oriented", _orient(pairs.df, neighbours.df, hot))
    lists = workspace.write("lists", _onward(oriented.df))
    asking = workspace.write("asking", _asking(lists.df, hot, candidates_per_slot))
    closed = _close(asking.df, lists.df, candidates_per_slot)
    links = closed.groupBy("v").agg(F.sum("links").alias("links"))
    degree = F.col("n")
    found = (
        neighbours.df.filter("n >= 2")
        .join(links, "v")
        .select(F.col("v").alias("found"), (F.col("links") / degree / (degree - 1)).alias("c"))
    )
    result = workspace.write(
        "coefficients",
        ready.vertices.select("id")
        .join(found, F.col("id") == F.col("found"), "left")
        .select("id", F.coalesce("c", F.lit(0.0)).alias("attr")),
    )
    for table in (pairs, neighbours, oriented, lists, asking):
        workspace.drop(table)
    return result.df


def _orient(pairs: DataFrame, neighbours: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``(lo, hi, w, n_lo)``: pairs from the end with fewer neighbours to
    the one with more, so that no vertex has many onward pairs: a vertex with k
    of them has k later vertices of degree k or more, so k*k is at most 2m."""
    known = pairs
    for end in ("a", "b"):
        table = neighbours.select("v", F.col("n").alias(f"n_{end}"))
        known = skew.lookup(known, end, table.hint("shuffle_hash"), "v", hot).drop("v")
    forward = F.struct("n_a", "a") < F.struct("n_b", "b")

    def pick(yes: str, no: str, name: str) -> Column:
        return F.when(forward, F.col(yes)).otherwise(F.col(no)).alias(name)

    return known.select(
        pick("a", "b", "lo"), pick("b", "a", "hi"), "w", pick("n_a", "n_b", "n_lo")
    )


def _onward(oriented: DataFrame) -> DataFrame:
    """``(v, n, onward, ids, ws)``: the onward vertices of each vertex that has
    some, with the directed edges to them, as one list each."""
    found = oriented.groupBy(F.col("lo").alias("v")).agg(
        F.max("n_lo").alias("n"), F.collect_list(F.struct("hi", "w")).alias("list")
    )
    return found.select(
        "v", "n", F.size("list").cast("bigint").alias("onward"),
        F.col("list.hi").alias("ids"), F.col("list.w").alias("ws"),
    )


def _slots(candidates_per_slot: int, neighbours: str, onward: str) -> Column:
    wanted = F.ceil(F.col(neighbours) * F.col(onward) / candidates_per_slot)
    return F.greatest(F.lit(1).cast("bigint"), wanted)


def _asking(lists: DataFrame, hot: DataFrame | None, candidates_per_slot: int) -> DataFrame:
    """``(probe, other, w, probe_slot, other_slot)`` of the pairs that may be the
    two lowest corners of a triangle; ``probe`` has no more onward vertices."""
    each = F.explode(F.arrays_zip("ids", "ws")).alias("pair")
    pairs = lists.filter("onward >= 2").select(
        F.col("v").alias("lo"), F.col("n").alias("n_lo"), F.col("onward").alias("onward_lo"), each
    ).select("lo", "n_lo", "onward_lo", F.col("pair.ids").alias("hi"), F.col("pair.ws").alias("w"))
    ends = lists.select("v", F.col("n").alias("n_hi"), F.col("onward").alias("onward_hi"))
    known = skew.lookup(pairs, "hi", ends.hint("shuffle_hash"), "v", hot)
    from_lo = F.col("onward_lo") <= F.col("onward_hi")
    place = F.xxhash64("lo", "hi")
    at_lo = F.pmod(place, _slots(candidates_per_slot, "n_lo", "onward_lo"))
    at_hi = F.pmod(place, _slots(candidates_per_slot, "n_hi", "onward_hi"))

    def pick(yes, no, name: str) -> Column:
        return F.when(from_lo, yes).otherwise(no).alias(name)

    return known.select(
        pick(F.col("lo"), F.col("hi"), "probe"), pick(F.col("hi"), F.col("lo"), "other"), "w",
        pick(at_lo, at_hi, "probe_slot"), pick(at_hi, at_lo, "other_slot"),
    )


def _close(asking: DataFrame, lists: DataFrame, candidates_per_slot: int) -> DataFrame:
    """``(v, links)``: for each triangle, each corner gets the number of directed
    edges between the other two.

    A triangle is found once, from the pair of its two lowest corners.  The
    third corner is sought among the onward vertices of the end that has fewer
    of them, which go as one list to the list of the other end; the candidates
    are the sum of the smaller counts over all pairs, and none is a row of its
    own.  A list is not longer than the root of twice the pairs.  A vertex
    asked by many pairs is split into slots: its list is copied to each, the
    asking pairs spread.
    """
    numbers = F.sequence(F.lit(0).cast("bigint"), _slots(candidates_per_slot, "n", "onward") - 1)

    def listed(end: str) -> DataFrame:
        # hashed, so that the long rows that meet a list need no order
        return lists.select(
            F.col("v").alias(end), F.explode(numbers).alias(f"{end}_slot"),
            F.col("ids").alias(f"{end}_ids"), F.col("ws").alias(f"{end}_ws"),
        ).hint("shuffle_hash")

    met = (
        asking.join(listed("probe"), ["probe", "probe_slot"])
        .select("probe", "other", "other_slot", "w", "probe_ids", "probe_ws")
        .join(listed("other"), ["other", "other_slot"])
        .filter(F.size(F.array_intersect("probe_ids", "other_ids")) > 0)
    )
    both = F.map_zip_with(
        F.map_from_arrays("probe_ids", "probe_ws"),
        F.map_from_arrays("other_ids", "other_ws"),
        lambda z, of_probe, of_other: F.struct(of_probe.alias("probe"), of_other.alias("other")),
    )
    triangles = met.select("probe", "other", "w", F.explode(both).alias("z", "of")).filter(
        "of.probe IS NOT NULL AND of.other IS NOT NULL"
    )
    corner = F.explode(
        F.array(
            F.struct(F.col("probe").alias("v"), F.col("of.other").alias("links")),
            F.struct(F.col("other").alias("v"), F.col("of.probe").alias("links")),
            F.struct(F.col("z").alias("v"), F.col("w").alias("links")),
        )
    )
    return triangles.select(corner.alias("c")).select("c.*")
