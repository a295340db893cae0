"""Traced runs, capture decisions and snapshots."""

import json
import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests import example
from tests.example import MAX, graph
from trailgraph.operators.aggregate import Send
from trailgraph.provenance import events, export, tables
from trailgraph.provenance.session import (
    CaptureFilter,
    DeltaPredicate,
    GraphPredicate,
    Hook,
    ProvenanceSession,
)
from trailgraph.provenance.setups import capture_for, flags, reached
from trailgraph.sinks.snapshots import StorageFormat, snapshot_sizes


def seen(session):
    return [(e.source, e.target, str(e.event)) for e in session.edges]


def values(frame):
    return {r["id"]: r["value"] for r in frame.collect()}


def is_join(edge):
    return edge.event == events.operation("joinVertices")


def test_bfs_event_sequence(spark):
    session = ProvenanceSession(spark)
    found = graph(spark).with_session(session).bfs(1)
    assert example.result(found) == example.BFS
    assert seen(session) == [
        (0, 1, "Operation(mapVertices)"),
        (1, 2, "Operation(mapVertices)"),
        (1, 2, "PregelLifecycleStart()"),
        (2, 3, "Operation(joinVertices)"),
        (2, 3, "PregelIteration(0)"),
        (3, 4, "Operation(joinVertices)"),
        (3, 4, "PregelIteration(1)"),
        (1, 4, "PregelAlgorithm()"),
        (0, 4, "BFS(1)"),
    ]
    assert all(e.source < e.target for e in session.edges)
    rounds = tables.messages_per_round(session.prov_metrics(), session.prov_edges())
    assert sorted((r["round"], r["messages"]) for r in rounds.collect()) == [(0, 3), (1, 0)]
    assert session.stored() == {}


def test_pagerank_event_sequence(spark, tmp_path):
    session = ProvenanceSession(
        spark,
        storage=True,
        directory=str(tmp_path),
        capture=capture_for("CombinedPruning", "PageRank"),
    )
    found = graph(spark).with_session(session).pagerank(2)
    assert example.result(found)[1] == pytest.approx(example.PAGERANK[1])
    assert seen(session) == [
        (0, 1, "Operation(outerJoinVertices)"),
        (1, 2, "Operation(mapTriplets)"),
        (2, 3, "Operation(mapVertices)"),
        (0, 3, "PregelLifecycleStart()"),
        (3, 4, "Operation(outerJoinVertices)"),
        (3, 4, "PregelIteration(0)"),
        (4, 5, "Operation(outerJoinVertices)"),
        (4, 5, "PregelIteration(1)"),
        (5, 6, "Operation(mapEdges)"),
        (5, 6, "PregelLifecycleStop()"),
        (0, 6, "PageRank(2,0.85)"),
    ]
    assert sorted(session.stored()) == [1, 4, 5]
    stored = session.snapshots()
    degrees = values(stored.filter("node_id = 1"))
    assert degrees == {1: 2, 2: 3, 3: 4, 5: 3, 6: 2, 7: 1, 8: 1, 9: 1}
    ranks = values(stored.filter("node_id = 5"))
    assert ranks == pytest.approx(example.PAGERANK)


@pytest.mark.parametrize(
    "name",
    ["TextFile()", "TextFile(true)", "ObjectFile()", "ParquetFile()", "ORCFile()",
     "CSVFile(true)", "CSVFile()", "JSONFormat(true)", "JSONFormat(false)"],
)
def test_snapshots_in_every_format(spark, tmp_path, name):
    session = ProvenanceSession(
        spark,
        storage=True,
        directory=str(tmp_path),
        storage_format=name,
        capture=CaptureFilter(edge=is_join, data=GraphPredicate(vertex=reached("SSSP"))),
    )
    graph(spark).with_session(session).sssp(1)
    last = max(session.stored())
    expected = {i: v for i, v in example.SSSP.items() if v < math.inf}
    assert values(session.snapshots().filter(F.col("node_id") == last)) == pytest.approx(expected)
    files = [p.name for p in tmp_path.rglob("part-*")]
    compressed = StorageFormat.parse(name).options.get("compression") == "gzip"
    assert files and all(f.endswith(".gz") == compressed for f in files)
    sizes = {
        r["node_id"]: (r["size"], r["location"])
        for r in snapshot_sizes(spark, {**session.stored(), 99: ""}).collect()
    }
    assert sizes[99] == (0, "<not stored>")
    assert all(sizes[n][0] > 0 for n in session.stored())


def test_format_strings():
    assert StorageFormat.parse("CSVFile(true)") == StorageFormat("CSVFile", True)
    assert StorageFormat.parse("TextFile(false)").extension == "txt"
    for wrong in ("ParquetFile(true)", "CSVFile", "XMLFile()", ""):
        with pytest.raises(ValueError):
            StorageFormat.parse(wrong)


def test_avro_without_its_package(spark, tmp_path):
    session = ProvenanceSession(
        spark, storage=True, directory=str(tmp_path), storage_format="AvroFile()",
        capture=CaptureFilter(),
    )
    with pytest.raises(AnalysisException, match="(?i)avro"):
        graph(spark).with_session(session).map_vertices("id")


def test_complete_capture_stores_each_graph_once(spark, tmp_path):
    session = ProvenanceSession(
        spark, storage=True, directory=str(tmp_path), capture=CaptureFilter()
    )
    graph(spark).with_session(session).bfs(1)
    assert sorted(session.stored()) == [1, 2, 3, 4]
    counts = session.snapshots().groupBy("node_id").count().collect()
    assert {r["node_id"]: r["count"] for r in counts} == {1: 10, 2: 10, 3: 10, 4: 10}
    stored = {r["node_id"]: r["event_name"] for r in session.snapshots().collect()}
    assert stored == {1: "mapVertices", 2: "mapVertices", 3: "joinVertices", 4: "joinVertices"}
    # The batch query over the tables decides the same.
    nothing_stored = session.prov_nodes().withColumn("location", F.lit(None).cast("string"))
    decided = tables.capture_decision(session.prov_edges(), nothing_stored, "true").collect()
    assert {r["target"]: r["event_name"] for r in decided} == stored


def test_delta_capture_keeps_the_graph_before(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (3,), (4,)], "id long")
    session = ProvenanceSession(
        spark,
        storage=True,
        directory=str(tmp_path),
        capture=CaptureFilter(edge=is_join, data=DeltaPredicate(ids)),
    )
    graph(spark).with_session(session).bfs(1)
    stored = session.snapshots()
    assert values(stored.filter("iteration = 0")) == {1: 0, 3: MAX, 4: MAX}
    assert values(stored.filter("iteration = 1")) == {1: 0, 3: 1, 4: MAX}


def test_nothing_captured_without_filter_or_storage(spark, tmp_path):
    unfiltered = ProvenanceSession(spark, storage=True, directory=str(tmp_path))
    graph(spark).with_session(unfiltered).map_vertices("id")
    assert unfiltered.stored() == {} and not list(tmp_path.iterdir())
    untraced = ProvenanceSession(spark, tracing=False, capture=CaptureFilter())
    graph(spark).with_session(untraced).bfs(1)
    assert untraced.edges == [] and untraced.metrics == []
    tracing_only = ProvenanceSession(spark, capture=CaptureFilter())
    graph(spark).with_session(tracing_only).map_vertices("id")
    assert tracing_only.stored() == {}


def test_tracing_runs_the_same_jobs(spark):
    def jobs(session):
        group = f"jobs-{id(session)}"
        spark.sparkContext.setJobGroup(group, group)
        g = graph(spark)
        (g.with_session(session) if session else g).bfs(1)
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(found)

    assert jobs(None) == jobs(ProvenanceSession(spark))


def test_hooks_add_metrics_at_chosen_events(spark):
    hook = Hook(
        event=lambda e: e == events.operation("removeSelfEdges"),
        pre=lambda g: {"edgesBefore": g.edges.count()},
        post=lambda g: {"edgesAfter": g.edges.count()},
    )
    session = ProvenanceSession(spark, hooks=(hook,))
    g = graph(spark, example.EDGES + [(4, 4, 1.0)]).with_session(session)
    g.map_vertices("id").remove_self_edges()
    found = {
        (r["owner_id"], r["name"]): r["value"]
        for r in session.prov_metrics().filter("kind = 'gauge'").collect()
    }
    assert found == {(1, "edgesBefore"): 18.0, (2, "edgesAfter"): 17.0}


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return action(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_observed_metrics_run_no_job(spark):
    reached_ = F.col("attr") < MAX
    hook = Hook(
        event=lambda e: e.event_type == events.PREGEL_ITERATION,
        observe={"low": F.min("attr"), "deep": F.max(F.when(reached_, F.col("attr"))), "reached": F.count_if(reached_)},
    )

    def traced(hooks):
        session = ProvenanceSession(spark, hooks=hooks)
        graph(spark).with_session(session).bfs(1)
        return session

    _, plain = jobs_of(spark, "plain", lambda: traced(()))
    session, observed = jobs_of(spark, "observed", lambda: traced((hook,)))
    assert observed == plain > 0
    found = {}
    for r in session.prov_metrics().filter("name IN ('low', 'deep', 'reached')").collect():
        found.setdefault(r["owner_id"], {})[r["name"]] = int(r["exact"])
    rounds = [e.target for e in session.edges if e.event.event_type == events.PREGEL_ITERATION]
    assert [found[n] for n in rounds] == [
        {"low": 0, "deep": 1, "reached": 3}, {"low": 0, "deep": 2, "reached": 6}]


@pytest.mark.parametrize("algorithm", ["pagerank", "cdlp", "wcc", "sssp", "pregel"])
def test_every_round_can_be_observed(spark, algorithm):
    hook = Hook(event=lambda e: e.event_type == events.PREGEL_ITERATION, observe={"rows": F.count("attr")})
    session = ProvenanceSession(spark, hooks=(hook,))
    g = graph(spark).map_vertices("id").with_session(session)
    if algorithm == "pregel":
        g.pregel(F.lit(0).cast("long"), lambda _, attr, msg: F.greatest(attr, msg),
                 [Send("dst", "src_attr", "src_attr > dst_attr")], F.max)
    else:
        getattr(g, algorithm)(*{"pagerank": (2,), "cdlp": (2,), "wcc": (), "sssp": (1,)}[algorithm])
    rows = session.prov_metrics().filter("name = 'rows'").collect()
    assert rows and all(r["exact"] == 10 for r in rows)
    assert len(rows) == sum(e.event.event_type == events.PREGEL_ITERATION for e in session.edges)


@pytest.mark.parametrize("storage_format", ["TextFile()", "ParquetFile()", "CSVFile(true)", "JSONFormat()", "ORCFile()"])
def test_snapshots_with_edges(spark, tmp_path, storage_format):
    session = ProvenanceSession(
        spark, storage=True, directory=str(tmp_path), storage_format=storage_format,
        capture=CaptureFilter(edge=is_join, data=GraphPredicate(vertex=reached("BFS")), edges=True),
    )
    graph(spark).with_session(session).bfs(1)
    nodes = sorted(session.captured)
    weights = {(s, d): w for s, d, w in example.EDGES}
    found = {}
    for r in session.snapshot_edges().collect():
        found.setdefault(r["node_id"], {})[r["src"], r["dst"]] = r["value"]
    for depth, node in enumerate(nodes, 1):
        inside = {v for v, hops in example.BFS.items() if hops <= depth}
        assert found[node] == {e: w for e, w in weights.items() if set(e) <= inside}
    assert set(values(session.snapshots().filter(F.col("node_id") == nodes[0]))) == {1, 3, 5}
    whole = tables.committed_snapshots(spark, str(tmp_path)).collect()
    assert sorted(r["node_id"] for r in whole) == nodes and all(r["with_edges"] for r in whole)


def test_deltas_have_no_edges(spark, tmp_path):
    ids = spark.range(1, 4)
    session = ProvenanceSession(
        spark, storage=True, directory=str(tmp_path),
        capture=CaptureFilter(edge=is_join, data=DeltaPredicate(ids), edges=True),
    )
    graph(spark).with_session(session).bfs(1)
    assert session.snapshot_edges().count() == 0 and session.snapshots().count() == 6


def test_runs_are_appended_once(spark, tmp_path):
    for run in ("a", "b", "a"):
        session = ProvenanceSession(spark, run_id=run)
        graph(spark).with_session(session).bfs(1)
        session.save(str(tmp_path))
    for name, schema in (("edges", tables.PROV_EDGES), ("nodes", tables.PROV_NODES), ("metrics", tables.PROV_METRICS)):
        stored = tables.stored_runs(spark, f"{tmp_path}/{name}", schema)
        counts = {r["run_id"]: r["count"] for r in stored.groupBy("run_id").count().collect()}
        one = getattr(session, f"prov_{name}")().count()
        assert counts == {"a": one, "b": one}
    again = tables.stored_runs(spark, f"{tmp_path}/edges", tables.PROV_EDGES).filter("run_id = 'a'")
    assert sorted(map(str, again.collect())) == sorted(map(str, session.prov_edges().collect()))


def test_predicates_over_the_record(spark):
    session = ProvenanceSession(
        spark, capture=CaptureFilter(edge=is_join, record=lambda n: n.location is None and n.metrics.get("iteration", 0) < 1)
    )
    graph(spark).with_session(session).bfs(1)
    assert len(session.captured) == 0 and len(session.locations) == 1
    node = session.node(session.edges[-1].target)
    assert node.metrics["iteration"] == 1 and node.location is None
    nodes = tables.with_metrics(session.prov_nodes(), session.prov_metrics(), ["activeMessages", "iteration"])
    busy = {r["node_id"] for r in nodes.filter("activeMessages > 0").collect()}
    chosen = tables.capture_decision(
        session.prov_edges(), session.prov_nodes().join(nodes.select("run_id", "node_id", "iteration"), ["run_id", "node_id"])
        .withColumn("location", F.lit(None).cast("string")),
        "event_name = 'joinVertices'", "iteration IS NULL OR iteration < 1",
    ).collect()
    assert busy and [r["target"] for r in chosen] == [3]


def test_pregel_and_components_leave_rounds(spark):
    session = ProvenanceSession(spark)
    g = graph(spark).with_session(session)
    assert example.result(g.wcc()) == example.WCC
    wcc_rounds = sum(e.event.event_type == events.PREGEL_ITERATION for e in session.edges)
    assert wcc_rounds == 3
    assert str(session.edges[-1].event) == "WCC(2147483647)"
    session = ProvenanceSession(spark)
    graph(spark).map_vertices("id").with_session(session).pregel(
        F.lit(0).cast("long"),
        lambda _, attr, msg: F.greatest(attr, msg),
        [Send("dst", "src_attr", "src_attr > dst_attr")],
        F.max,
    )
    kinds = [e.event.event_type for e in session.edges]
    assert kinds[0] == events.OPERATION and kinds[1] == events.PREGEL_START
    assert kinds[-1] == events.PREGEL


def test_flags():
    assert flags("Baseline") == (False, False)
    assert flags("Tracing") == (True, False)
    for setup in (
        "CompleteProvenance", "ProvenanceGraphPruning", "DataGraphPruning", "CombinedPruning"
    ):
        assert flags(setup) == (True, True)
    with pytest.raises(ValueError):
        flags("Sometimes")


def test_reached_predicate(spark):
    edges = spark.createDataFrame(
        [(1, 2, 0.2), (2, 3, 0.2), (3, 1, 0.2)], "src long, dst long, attr double"
    )
    longs = spark.createDataFrame([(1, 1), (2, MAX), (3, MAX)], "id long, attr long")
    doubles = spark.createDataFrame(
        [(1, 1.0), (2, math.inf), (3, math.inf)], "id long, attr double"
    )
    from trailgraph.graph import PropertyGraph

    def kept(vertices, setup, algorithm):
        rule = capture_for(setup, algorithm).data
        return PropertyGraph(vertices, edges).subgraph(rule.vertex, rule.edge).vertices.count()

    assert kept(longs, "DataGraphPruning", "WCC") == 1
    assert kept(longs, "Baseline", "WCC") == 3
    assert kept(doubles, "DataGraphPruning", "SSSP") == 1


def prov_rows(spark):
    edges = [
        ("r", 0, 1, 2, "operation", "joinVertices", {}),
        ("r", 1, 2, 3, "operation", "mapVertices", {}),
        ("r", 2, 3, 4, "operation", "joinVertices", {}),
        ("r", 3, 1, 4, "algorithm", "BFS", {"source": "3"}),
    ]
    nodes = [("r", i, None) for i in (1, 2, 3, 4)]
    return (
        spark.createDataFrame(nodes, tables.PROV_NODES),
        spark.createDataFrame(edges, tables.PROV_EDGES),
    )


def test_provenance_filter_and_lookup(spark):
    nodes, edges = prov_rows(spark)
    joins = tables.join_event_predicate(F.lit("BFS"))
    kept, passing = tables.prov_filter(nodes, edges, tables.everything(), joins)
    assert (kept.count(), passing.count()) == (4, 2)
    kept, passing = tables.prov_filter(nodes, edges, "node_id <> 2", tables.everything())
    assert (kept.count(), passing.count()) == (3, 2)
    kept, passing = tables.prov_filter(nodes, edges, tables.nothing(), tables.everything())
    assert (kept.count(), passing.count()) == (0, 0)
    assert tables.node_by_id(nodes, "r", 3).count() == 1
    assert tables.node_by_id(nodes, "r", 9).count() == 0
    assert tables.append(edges, edges).count() == 8


def test_capture_decision_skips_stored_and_released(spark):
    _, edges = prov_rows(spark)
    edges = edges.filter("seq < 3").unionByName(
        spark.createDataFrame(
            [
                ("r", 4, 4, 5, "operation", "unpersist", {}),
                ("r", 5, 3, 4, "pregelIteration", "PregelIteration", {"i": "0"}),
            ],
            tables.PROV_EDGES,
        )
    )
    nodes = spark.createDataFrame(
        [("r", 2, "somewhere"), ("r", 3, None), ("r", 4, None), ("r", 5, None)],
        tables.PROV_NODES,
    )
    found = tables.capture_decision(edges, nodes, "true").collect()
    assert {(r["target"], r["seq"], r["event_name"]) for r in found} == {
        (3, 1, "mapVertices"),
        (4, 2, "joinVertices"),
    }


def test_metric_algebra(spark):
    deltas = spark.createDataFrame(
        [("r", "c", 1), ("r", "c", 1), ("r", "c", -1)], "run_id string, name string, delta long"
    )
    assert tables.counter_values(deltas).first()["value"] == 1
    rows = [
        ("r", "node", 1, "gauge", "numVertices", 10.0, None),
        ("r", "node", 1, "gauge", "numVertices", 10.0, None),
        ("r", "node", 2, "gauge", "numVertices", 12.0, None),
    ]
    schema = "run_id string, owner string, owner_id long, kind string, name string, value double, unit string"
    total = tables.metric_totals(spark.createDataFrame(rows, schema)).first()
    assert (total["observations"], total["total"], total["lowest"]) == (2, 22.0, 10.0)
    assert total["exact_total"] is None


def test_metrics_of_any_type(spark):
    session = ProvenanceSession(spark, run_id="r")
    big = 2**53 + 1
    for node, value in ((0, big), (1, big), (2, -3)):
        session.counter(node, "bytes", value)
    session.gauge(0, "state", "ready")
    session.gauge(1, "state", "done")
    session.gauge(0, "settled", True)
    session.gauge(0, "mass", 0.25)
    session.gauge(0, "nothing", None)
    found = {r["name"]: r for r in tables.metric_totals(session.prov_metrics()).collect()}
    assert found["bytes"]["exact_total"] == 2 * big - 3 and found["bytes"]["exact_highest"] == big
    assert (found["state"]["first_text"], found["state"]["last_text"]) == ("done", "ready")
    assert found["settled"]["first_text"] == "true" and found["mass"]["total"] == 0.25
    assert found["mass"]["exact_total"] is None and "nothing" not in found
    lines = [r["line"] for r in export.json_node_metrics(session.prov_metrics()).collect()]
    assert sum(f'"value":"{big}"' in line for line in lines) == 2
    assert any('"name":"state"' in line and '"value":"done"' in line for line in lines)


def test_many_metrics_of_one_edge(spark):
    rows = spark.range(20_000).select(
        F.lit("r").alias("run_id"), F.lit("edge").alias("owner"), F.lit(0).cast("long").alias("owner_id"),
        F.lit("counter").alias("kind"), F.concat(F.lit("m"), F.col("id")).alias("name"),
        F.col("id").cast("double").alias("value"), F.lit(None).cast("string").alias("unit"),
    )
    session = ProvenanceSession(spark, run_id="r")
    graph(spark).with_session(session).map_vertices("id")
    lines = export.json_edges(session.prov_edges(), rows).collect()
    parts = [json.loads(r["line"])["metrics"]["values"][0] for r in lines]
    assert sorted(r["part"] for r in lines) == list(range(20))
    assert max(map(len, parts)) < 2 * export.PART_METRICS
    assert len({m["name"] for part in parts for m in part}) == 20_000 == sum(map(len, parts))
