"""Graph operators on small graphs with every odd case."""

import pytest
from pyspark.sql import functions as F

from tests.example import graph
from trailgraph.graph import PropertyGraph
from trailgraph.operators.aggregate import Merge, Send
from trailgraph.operators.joins import verify_result
from trailgraph.plans import skew
from trailgraph.plans.layout import partitions_for

ROWS = [(1, 2, 1.0), (1, 2, 3.0), (2, 1, 2.0), (3, 3, 5.0), (2, 9, 4.0)]


@pytest.fixture(scope="module")
def small(spark):
    g = graph(spark, ROWS, [1, 2, 3, 4])
    return g.map_vertices("id * 10")


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_vertices_include_endpoints(spark, small):
    assert rows(small.vertices) == [(1, 10), (2, 20), (3, 30), (4, 40), (9, 90)]
    assert small.num_vertices() == 5
    listed = spark.createDataFrame([(1, "a"), (4, "b")], "id long, attr string")
    g = PropertyGraph.from_edges(small.edges, listed)
    assert {r["id"]: r["attr"] for r in g.vertices.collect()} == {
        1: "a", 2: None, 3: None, 4: "b", 9: None
    }


def test_maps(small):
    assert rows(small.map_edges("attr * 2").edges)[0] == (1, 2, 2.0)
    mapped = small.map_triplets("src_attr - dst_attr + attr").edges
    assert rows(mapped) == [(1, 2, -9.0), (1, 2, -7.0), (2, 1, 12.0), (2, 9, -66.0), (3, 3, 5.0)]
    one_end = small.map_triplets("src_attr", ends=("src",)).edges
    assert rows(one_end) == [(1, 2, 10), (1, 2, 10), (2, 1, 20), (2, 9, 20), (3, 3, 30)]
    assert "Join" not in str(
        small.map_triplets("attr", ends=()).edges._jdf.queryExecution().optimizedPlan()
    )


def test_subgraph_leaves_no_dangling_edge(small):
    kept = small.subgraph("id <> 9", "attr < 5 AND src_attr < 40")
    assert rows(kept.edges) == [(1, 2, 1.0), (1, 2, 3.0), (2, 1, 2.0)]
    ids = {r["id"] for r in kept.vertices.collect()}
    assert ids == {1, 2, 3, 4}
    assert all(r["src"] in ids and r["dst"] in ids for r in kept.edges.collect())
    assert rows(small.subgraph().edges) == rows(small.edges)


def test_self_and_canonical_edges(small):
    assert rows(small.remove_self_edges().edges) == rows(small.edges.filter("src <> 3"))
    assert rows(small.canonical_edges().edges) == [(1, 2, 1.0), (2, 9, 4.0), (3, 3, 5.0)]
    assert rows(small.canonical_edges(F.sum).edges)[0] == (1, 2, 6.0)


def test_vertex_joins(spark, small):
    table = spark.createDataFrame([(1, 7), (9, 8), (77, 1)], "id long, attr long")
    joined = small.join_vertices(table, "attr + new").vertices
    assert rows(joined) == [(1, 17), (2, 20), (3, 30), (4, 40), (9, 98)]
    outer = small.outer_join_vertices(table, F.coalesce("new", F.lit(0)) + F.col("id")).vertices
    assert rows(outer) == [(1, 8), (2, 2), (3, 3), (4, 4), (9, 17)]
    assert rows(small.inner_join_vertices(table)) == [(1, 10), (9, 90)]
    assert rows(small.vertices_minus(table)) == [(2, 20), (3, 30), (4, 40)]
    assert rows(small.restrict_vertices(table).vertices) == [(1, 10), (9, 90)]


def test_degrees_and_messages(small):
    assert rows(small.out_degrees()) == [(1, 2), (2, 2), (3, 1)]
    both = [Send("dst", "src_attr"), Send("src", "dst_attr", "src <> dst")]
    found = small.aggregate_messages(both, F.sum)
    # 1: 20 back, twice 20 ahead; 2: 10 twice, then 10 and 90 ahead.
    assert rows(found) == [(1, 60), (2, 120), (3, 30), (9, 20)]


@pytest.mark.parametrize("part_ids", [100_000, 2])
def test_lists_are_whole_in_any_number_of_parts(small, part_ids):
    parts = small.collect_edges("either", part_ids).collect()
    lists = {}
    for r in parts:
        lists.setdefault(r["id"], []).extend(tuple(e)[:3] for e in r["edges"] for _ in range(e["n"]))
    # A self-loop is incident at both of its ends.
    assert {k: sorted(v) for k, v in lists.items()} == {
        1: [(1, 2, 1.0), (1, 2, 3.0), (2, 1, 2.0)],
        2: [(1, 2, 1.0), (1, 2, 3.0), (2, 1, 2.0), (2, 9, 4.0)],
        3: [(3, 3, 5.0), (3, 3, 5.0)],
        9: [(2, 9, 4.0)],
    }
    assert (max(r["part"] for r in parts) > 0) == (part_ids == 2)
    near = small.collect_neighbors("out", part_ids).filter("id = 1").collect()
    assert [(r["part"], *map(tuple, r["neighbors"])) for r in near] == [(2 // part_ids, (2, 20, 2))]
    back = small.collect_neighbors("in").filter("id = 2").first()
    assert [tuple(n) for n in back["neighbors"]] == [(1, 10, 2)]


def test_verify_result(spark):
    inf = float("inf")
    expected = spark.createDataFrame([(1, 0.5), (2, inf), (3, 1.0)], "id long, value double")
    near = spark.createDataFrame([(1, 0.5 + 1e-9), (2, inf), (3, 1.0)], "id long, value double")
    assert verify_result(near, expected).count() == 0
    wrong = spark.createDataFrame([(1, 0.6), (2, 7.0), (4, 1.0)], "id long, value double")
    assert sorted(r["id"] for r in verify_result(wrong, expected).collect()) == [1, 2, 3, 4]
    longs = spark.createDataFrame([(1, 5), (2, 6)], "id long, value long")
    other = spark.createDataFrame([(1, 5), (2, 7)], "id long, value long")
    assert [r["id"] for r in verify_result(longs, other).collect()] == [2]


def test_lookup_with_hot_keys(spark):
    left = spark.createDataFrame([(k, i) for i in range(30) for k in (1, i)], "k long, i long")
    table = spark.createDataFrame([(k, k * k) for k in range(25)], "id long, square long")
    hot = spark.createDataFrame([(1,)], "hot_id long")
    plain = skew.lookup(left, "k", table, "id").select("k", "i", "square")
    split = skew.lookup(left, "k", table, "id", hot).select("k", "i", "square")
    assert rows(plain) == rows(split) and len(rows(plain)) == 30 + 25


def test_bounds(spark):
    assert skew.threshold(1000) == skew.MIN_HOT_ROWS
    huge = 10**13
    assert huge / skew.threshold(huge) <= skew.MAX_HOT_KEYS
    assert partitions_for(spark, 10) == 1
    assert partitions_for(spark, 400_000) == 8
    assert partitions_for(spark, 10**12) == 250_000


def test_merges_of_the_users_own(spark, monkeypatch):
    """A bit sketch with a partial step before the shuffle."""
    edges = spark.range(5000).select((F.col("id") * 7 % 1000).alias("src"), (F.col("id") % 20).alias("dst"))
    g = PropertyGraph.from_edges(edges.repartition(4))

    def union(values, starts):
        import numpy as np

        return np.bitwise_or.reduceat(values.to_numpy(), starts)

    bit = F.expr("shiftleft(1L, cast(src % 60 as int))")
    found = g.aggregate_messages([Send("dst", bit)], Merge(union), ends=())
    expected = g.aggregate_messages([Send("dst", bit)], F.bit_or, ends=())
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    plan = g.aggregate_messages([Send("dst", bit)], Merge(union), ends=())._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow after") < plan.index("hashpartitioning(id") < plan.index("MapInArrow before")
    assert g.aggregate_messages([Send("dst", bit, "src < 0")], Merge(union), ends=()).count() == 0
    vertices = g.map_vertices("id")
    rounds = vertices.pregel(
        F.lit(0).cast("long"), lambda _, attr, msg: F.greatest(attr, msg), [Send("dst", "src_attr", "src_attr > dst_attr")],
        Merge(lambda values, starts: __import__("numpy").maximum.reduceat(values.to_numpy(), starts)),
    )
    plain = vertices.pregel(
        F.lit(0).cast("long"), lambda _, attr, msg: F.greatest(attr, msg), [Send("dst", "src_attr", "src_attr > dst_attr")], F.max,
    )
    assert sorted(map(tuple, rounds.vertices.collect())) == sorted(map(tuple, plain.vertices.collect()))


def test_one_row_per_vertex(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    rows = spark.createDataFrame([(1, 5.0), (1, 3.0), (3, None), (3, 1.0)], "id long, attr double")
    g = PropertyGraph.from_edges(edges, rows)
    assert {r["id"]: r["attr"] for r in g.vertices.collect()} == {1: 3.0, 2: None, 3: 1.0}
    assert g.vertices.count() == 3 and g.triplets().count() == 1
    maps = rows.select("id", F.create_map(F.lit("a"), "attr").alias("attr"))
    assert PropertyGraph.from_edges(edges, maps).vertices.count() == 3
