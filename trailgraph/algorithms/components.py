"""Weakly connected components."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from trailgraph.algorithms.common import is_traced, message_passing, preparation
from trailgraph.graph import PropertyGraph
from trailgraph.plans import skew
from trailgraph.plans.prepared import PreparedGraph, symmetric
from trailgraph.plans.rounds import Outcome, relax
from trailgraph.provenance import events
from trailgraph.workspace import Table, Workspace

# Rounds of passing ids on before what is left is contracted.
FIRST_ROUNDS = 6
# Maps composed in one plan before the result is written.
MAPS_PER_PLAN = 6


def wcc(
    graph: PropertyGraph,
    max_iter: int | None = None,
    prepared: PreparedGraph | None = None,
    first_rounds: int = FIRST_ROUNDS,
) -> PropertyGraph:
    """The smallest vertex id of each vertex's component, edges taken both ways.

    With ``max_iter``, exactly that many rounds of passing the smallest id on to
    the neighbours, fewer when it settles earlier.  Without a cap, at most
    ``first_rounds`` of them, which settles graphs of small diameter; what is
    left is contracted, in rounds that grow with the logarithm of the graph and
    not with its diameter.  A traced run only passes ids, since its intermediate
    graphs are the ones provenance is about.
    """
    if max_iter is not None and max_iter <= 0:
        raise ValueError(f"the number of iterations must be above 0, got {max_iter}")
    with preparation(graph, prepared) as ready:
        workspace = Workspace(ready.spark, "wcc")
        initial = ready.vertices.select(
            "id", F.col("id").alias("value"), F.lit(True).alias("changed")
        )

        def passed_on(rounds: int | None, recorder=None) -> Outcome:
            return relax(workspace, ready.both_ways, initial, F.col("value"), rounds, recorder)

        if max_iter is None and not is_traced(graph):
            outcome = passed_on(first_rounds)
            labels = outcome.table.df.select("id", F.col("value").alias("rep"))
            if outcome.settled:
                vertices = _written(workspace, outcome.table, labels)
            else:
                vertices = _contract(ready, workspace, labels)
                workspace.drop(outcome.table)
            return graph.derive(vertices=vertices)

        def setup(start: PropertyGraph) -> PropertyGraph:
            return replace(start, vertices=ready.vertices).map_vertices("id")

        def run(recorder) -> DataFrame:
            table = passed_on(max_iter, recorder).table
            return _written(workspace, table, table.df.select("id", F.col("value").alias("rep")))

        limit = events.UNBOUNDED_ITERATIONS if max_iter is None else max_iter
        return message_passing(graph, events.algorithm("WCC", limit), setup, run)


def _written(workspace: Workspace, table: Table, labels: DataFrame) -> DataFrame:
    """Labels as vertices that outlive the prepared graph."""
    vertices = labels.select("id", F.col("rep").alias("attr"))
    return vertices if table.path else workspace.write("alone", vertices).df


def _hot(table: DataFrame, total: int, largest: int, min_hot_rows: int | None) -> DataFrame | None:
    """The hot ids of ``table (id, degree)``, if there are any."""
    limit = skew.threshold(total, min_hot_rows)
    if largest <= limit:
        return None
    return table.filter(F.col("degree") > limit).select(F.col("id").alias("hot_id"))


def _contract(ready: PreparedGraph, workspace: Workspace, labels: DataFrame) -> DataFrame:
    """Components by randomised contraction, after Bögeholz, Brand and Todor,
    In-database connected component analysis (2020), from the edges between the
    given ``labels (id, rep)`` on.

    Each round every vertex points to the neighbour (or itself) that comes first
    in a random order, follows its pointer once more, and the edges are
    rewritten to where that leads, without loops and copies.  The number of
    vertices left falls by a constant factor in expectation, so all rounds
    together move little more than the first.
    """
    degree = F.col("out_degree") + F.col("in_degree")
    hot = _hot(
        ready.vertices.select("id", degree.alias("degree")),
        ready.counts["edges"],
        ready.counts["max_degree"],
        ready.min_hot_rows,
    )
    # xxhash64 maps no two longs to one, so the places in the random order can
    # stand for the labels from here on.
    placed = labels.select("id", F.xxhash64("rep").alias("rep"))
    plain = ready.edges.select("src", "dst")
    edges = _rewritten(workspace, "edges=0", _moved(plain, placed, hot))
    maps: list[Table] = []
    while edges.observed["edges"] > 0:
        number = len(maps)
        first = workspace.write(
            f"map={number}", _representatives(edges.df), largest=F.max("degree")
        )
        maps.append(first)
        hot = _hot(
            first.df, edges.observed["edges"], first.observed["largest"], ready.min_hot_rows
        )
        # Pointers lead to a neighbour: those that share a target are no more
        # than its edges.
        pointers = first.df.select(F.col("id").alias("of"), "rep")
        onward = first.df.select("id", F.col("rep").alias("final"))
        followed = skew.lookup(pointers, "rep", onward, "id", hot).select(
            F.col("of").alias("id"), F.col("final").alias("rep")
        )
        following = _rewritten(
            workspace, f"edges={number + 1}", _moved(edges.df, followed, hot)
        )
        workspace.drop(edges)
        edges = following
    workspace.drop(edges)
    result = workspace.write("components", _smallest(workspace, labels, _compose(workspace, maps)))
    for table in maps:
        workspace.drop(table)
    return result.df


def _moved(edges: DataFrame, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Edges with both ends replaced by their ``rep`` in ``table (id, rep)``."""
    moved = edges
    for end in ("src", "dst"):
        named = table.select("id", F.col("rep").alias(f"new_{end}"))
        moved = skew.lookup(moved, end, named, "id", hot).drop("id")
    return moved.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def _rewritten(workspace: Workspace, name: str, edges: DataFrame) -> Table:
    """Undirected edges without loops and copies."""
    pairs = (
        edges.filter("src <> dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )
    return workspace.write(name, pairs, edges=F.count(F.lit(1)))


def _representatives(edges: DataFrame) -> DataFrame:
    """``(id, rep, degree)``: the first of each vertex and its neighbours.

    The order stays the same over the rounds: the hub of a star passes its place
    on to its first leaf, to which all others point in the round after.
    """
    first = symmetric(edges).groupBy(F.col("src").alias("id")).agg(
        F.min("dst").alias("first"), F.count(F.lit(1)).alias("degree")
    )
    return first.select("id", F.least("first", "id").alias("rep"), "degree")


def _compose(workspace: Workspace, maps: list[Table]) -> DataFrame | None:
    """``(id, rep)`` from each vertex with an edge to its last representative.

    Built from the last, smallest map back, so that all steps together read
    each map once.
    """
    if not maps:
        return None
    composed = maps[-1].df.select("id", "rep")
    # Every round follows its pointers twice.
    earlier = [table for table in maps for _ in range(2)][:-1]
    for step, table in enumerate(reversed(earlier), start=1):
        onward = composed.select(F.col("id").alias("via"), F.col("rep").alias("final"))
        composed = (
            table.df.select("id", "rep")
            .join(onward, F.col("rep") == F.col("via"), "left")
            .select("id", F.coalesce("final", "rep").alias("rep"))
        )
        if step % MAPS_PER_PLAN == 0:
            composed = workspace.write(f"composed={step}", composed).df
    return composed


def _smallest(workspace: Workspace, labels: DataFrame, composed: DataFrame | None) -> DataFrame:
    """``(id, attr)``: the smallest id in the component.

    The smallest id of a component is a label itself, so the smallest label that
    shares the representative is it.  The smallest ones are a table of their
    own: a join with an aggregate could not be split, and the representative of
    a giant component is a hot key.
    """
    if composed is None:
        return labels.select("id", F.col("rep").alias("attr"))
    known = (
        labels.select(F.col("rep").alias("label"))
        .distinct()
        .join(composed, F.xxhash64("label") == F.col("id"))
        .select("label", F.col("rep").alias("of"))
    )
    known = workspace.write("known", known).df
    least = workspace.write("least", known.groupBy("of").agg(F.min("label").alias("smallest"))).df
    renamed = known.join(least, "of").select("label", "smallest")
    return labels.join(renamed, F.col("rep") == F.col("label"), "left").select(
        "id", F.coalesce("smallest", "rep").alias("attr")
    )
