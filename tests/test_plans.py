"""The physical plans of the rounds, as they are when nothing is small."""

import re

import pytest
from pyspark.sql import functions as F

from tests.example import graph, result
from tests.test_algorithms import random_graph
from trailgraph import workspace
from trailgraph.plans import layout, rounds
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.plans.rounds import relax


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of all written tables by name, without automatic broadcasts."""
    seen = {}
    write = workspace.Workspace.write

    def recording(self, name, df, **options):
        seen[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, name, df, **options)

    monkeypatch.setattr(workspace.Workspace, "write", recording)
    monkeypatch.setattr(layout, "SMALL_EDGES_PER_PARTITION", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def operators(plan):
    found = []
    for line in plan.splitlines():
        match = re.match(r"[\s:+|-]*(?:\*\(\d+\) )?(\w+)", line)
        if match:
            found.append(match[1])
    return found


def test_rounds_keep_their_size_and_their_edges(spark, plans):
    rows = [(i, i + 1, 1.0) for i in range(30)]
    ready = PreparedGraph(graph(spark, rows, range(31)))
    ready.graph.bfs(0, prepared=ready)
    found = [operators(plans[f"round={i}"]) for i in (1, 10, 28)]
    assert found[0] == found[1] == found[2]
    # One exchange for the senders, one for the merge; no edge is moved or sorted, nothing is cached.
    assert found[0].count("Exchange") == 2
    assert "Sort" not in found[0] and "InMemoryTableScan" not in found[0]
    assert plans["round=10"].count("Bucketed: true") == 1
    ready.release()


def test_sparse_rounds_touch_what_they_need(spark, plans, monkeypatch):
    monkeypatch.setattr(layout, "SMALL_EDGES_PER_PARTITION", 50)
    rows = [(i, i + 1, 1.0) for i in range(2000)]
    ready = PreparedGraph(graph(spark, rows, range(2001)))
    sizes = {}
    written = workspace.Workspace.write

    def measuring(self, name, df, **options):
        table = written(self, name, df, **options)
        sizes[name] = table.df.count()
        return table

    monkeypatch.setattr(workspace.Workspace, "write", measuring)
    space = workspace.Workspace(spark, "sparse")
    start = ready.vertices.select(
        "id", F.when(F.col("id") == 0, 0).otherwise(9999).cast("long").alias("value"),
        (F.col("id") == 0).alias("changed"),
    )
    outcome = relax(space, ready.outgoing, start, F.col("value") + 1, max_rounds=10)
    values = {r["id"]: r["value"] for r in outcome.table.df.collect()}
    assert values == {i: i if i <= 10 else 9999 for i in range(2001)}
    # The first round is whole; after it, one vertex sends and one falls.
    assert sizes["round=0"] == 2001 and "round=1" not in sizes
    assert all(sizes[f"messages={k}"] == sizes[f"delta={k}"] == 1 for k in range(1, 10))
    for name, key in (("messages=9", "src"), ("delta=9", "id")):
        pruned = re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plans[name])
        assert pruned and all(int(read) == 1 < int(of) for read, of in pruned)
        assert f"In({key}" in plans[name] or f"EqualTo({key}" in plans[name]
    assert not outcome.settled
    ready.release()


def test_sparse_rounds_give_the_same(spark, monkeypatch):
    _, _, g = random_graph(spark, 1)
    expected = {name: result(getattr(g, name)(0)) for name in ("bfs", "sssp")}
    monkeypatch.setattr(rounds, "SPARSE_SHARE", 1)
    for named, most in ((1000, 16), (0, 2)):
        monkeypatch.setattr(rounds, "NAMED_IDS", named)
        monkeypatch.setattr(rounds, "MOST_DELTAS", most)
        assert {name: result(getattr(g, name)(0)) for name in expected} == expected
        assert result(g.wcc()) == result(g.wcc(50))


def test_pagerank_rounds(spark, plans):
    _, _, g = random_graph(spark, 4)
    ready = PreparedGraph(g)
    g.pagerank(4, prepared=ready)
    assert operators(plans["round=1"]) == operators(plans["round=3"])
    assert operators(plans["round=3"]).count("Exchange") == 2
    assert "CartesianProduct" not in plans["round=3"]
    ready.release()


def test_hubs_are_met_by_broadcast(spark, plans):
    _, _, g = random_graph(spark, 4)
    ready = PreparedGraph(g, min_hot_rows=3)
    g.bfs(0, prepared=ready)
    found = operators(plans["round=1"])
    assert "InMemoryTableScan" not in found
    assert "BroadcastHashJoin" in found and "ShuffledHashJoin" in found
    ready.release()


def test_only_needed_columns_are_read(spark, plans):
    _, _, g = random_graph(spark, 4)
    ready = PreparedGraph(g)
    ready.counts
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plans["vertices"])
    assert sorted(schemas)[:2] == ["dst:bigint", "src:bigint"]
    ready.release()
