"""Working tables live in the folder the cluster names."""

import os

from pyspark.sql import functions as F

from tests.example import graph, result
from trailgraph import workspace
from trailgraph.plans.prepared import PreparedGraph


def folders(root):
    return [name for _, names, _ in os.walk(root) for name in names]


def test_tables_below_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "work_root", lambda _: str(tmp_path))
    ready = PreparedGraph(graph(spark))
    found = ready.graph.bfs(1, prepared=ready)
    # Superseded rounds are gone, the last one holds the result.
    rounds = [name for name in folders(tmp_path) if name.startswith("round=")]
    assert rounds == ["round=1"]
    ready.release()
    assert not [name for name in folders(tmp_path) if name.startswith("prepared-")]
    assert result(found)[10] == 2
    workspace.clear_session(spark)
    assert folders(tmp_path) == []


def test_the_configured_folder_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = workspace.work_root(spark)
    assert root == configured if configured else os.path.isdir(root)


def test_metrics_come_with_the_write(spark):
    space = workspace.Workspace(spark, "test")
    table = space.write(
        "t", spark.range(10), rows=F.count(F.lit(1)), total=F.sum("id"), none=F.max(F.lit(None))
    )
    assert table.observed == {"rows": 10, "total": 45, "none": None}
    assert table.df.schema["id"].dataType.simpleString() == "bigint"
    space.drop(table)
    assert not os.path.exists(table.path)
    space.clear()


def test_stored_graphs_are_equal(spark):
    g = graph(spark)
    kept = g.stored()
    assert sorted(map(tuple, kept.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    assert sorted(r["id"] for r in kept.vertices.collect()) == list(range(1, 11))
    assert kept.edges_stored and PreparedGraph(kept).edges is kept.edges
    assert kept.map_vertices("id").edges_stored and not kept.remove_self_edges().edges_stored
    assert result(kept.wcc()) == result(g.wcc())
