"""Work that is dealt out over tasks, and derived graphs that are computed once."""

import json
import os
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.test_algorithms import random_graph
from trailgraph import PropertyGraph, queries, views
from trailgraph.algorithms import clustering
from trailgraph.plans import layout, rounds
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.provenance import tables
from trailgraph.provenance.session import ProvenanceSession
from trailgraph.provenance.setups import capture_for
from trailgraph.sources import runlogs
from trailgraph.workspace import Workspace

SF = "/root/testdata/sf0.001"


def writers(root) -> set:
    """The numbers of the tasks that wrote the files below ``root``."""
    names = [name for _, _, files in os.walk(root) for name in files]
    return {found[1] for name in names if (found := re.match(r"part-(\d+)-", name))}


def is_scan(df) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Join" not in plan and "lineitem" not in plan and "l_orderkey" not in plan


def test_paired_tree_is_written_by_many_tasks(spark, tmp_path):
    root = f"{tmp_path}/records"
    sides = F.explode(F.array(F.lit(True), F.lit(False)))
    records = spark.range(40).select("id", sides.alias("lineage")).select(
        (F.col("id") % 3).alias("experiment"), F.col("id").cast("string").alias("run"), "lineage",
        F.lit("bfs").alias("algorithm"), F.lit("wiki").alias("graph"),
        F.struct(
            F.col("id").cast("string").alias("lineageDirectory"),
            F.struct(
                F.when(F.col("lineage"), 2.0).otherwise(1.0).alias("duration"), F.lit("s").alias("unit")
            ).alias("duration"),
            F.array(F.struct(F.lit(1).alias("idx"), F.lit(5).cast("bigint").alias("messageCount"))).alias("iterations"),
        ).alias("metadata"),
    )
    runlogs.save_paired(records, root)
    assert len(writers(root)) > 1
    # files elsewhere in the tree are no records
    for place in ("experiment=0", "experiment=0/run=0", "experiment=0/run=0/lineage=true/old", "notes"):
        os.makedirs(f"{root}/{place}", exist_ok=True)
        with open(f"{root}/{place}/other.json", "w") as file:
            json.dump({"algorithm": "x", "graph": "y"}, file)
    found = runlogs.load_paired(spark, root).collect()
    assert sorted(int(row["lineage_id"]) for row in found) == list(range(40))
    assert {(row["with_lineage"], row["without_lineage"], row["iterations"]) for row in found} == {(2.0, 1.0, 1)}
    assert {row["run"] for row in found} == {f"experiment={n % 3}/run={n}" for n in range(40)}


def paired_records(spark, rows):
    """Records of ``(experiment, run, lineage, duration)``."""
    return spark.createDataFrame(rows, "experiment bigint, run string, lineage boolean, duration double").select(
        "experiment", "run", "lineage", F.lit("bfs").alias("algorithm"), F.lit("wiki").alias("graph"),
        F.struct(
            F.col("run").alias("lineageDirectory"),
            F.struct(F.col("duration").alias("duration"), F.lit("s").alias("unit")).alias("duration"),
            F.lit(None).cast("array<struct<idx: int, messageCount: bigint>>").alias("iterations"),
        ).alias("metadata"),
    )


def test_record_files_are_as_spark_writes_them_and_nothing_beside(spark, tmp_path):
    names = ["a", "b c", "d=e/f", "g%h", "[i]{j}", "", None, "\u00fc"]
    rows = [(None if n == 3 else n % 2, name, side, float(n)) for n, name in enumerate(names) for side in (True, False)]
    rows.append((0, "a", True, 9.0))  # the same run and side once more
    records = paired_records(spark, rows)
    runlogs.save_paired(records, f"{tmp_path}/mine")
    folders = ["experiment", "run", "lineage"]
    written = records.withColumn("lineage", F.col("lineage").cast("string")).repartition(3, *folders)
    written.write.option("maxRecordsPerFile", 1).partitionBy(*folders).json(f"{tmp_path}/spark")

    def lines(root):
        return sorted(
            (os.path.relpath(place, root), open(f"{place}/{name}", encoding="utf-8").read())
            for place, _, files in os.walk(root) for name in files if re.match("part-.*json$", name)
        )

    assert lines(f"{tmp_path}/mine") == lines(f"{tmp_path}/spark")
    assert sum(len(files) for _, _, files in os.walk(f"{tmp_path}/mine")) == len(rows)
    both = [sorted(map(str, runlogs.load_paired(spark, f"{tmp_path}/{root}").collect())) for root in ("mine", "spark")]
    assert both[0] == both[1] and len(both[0]) == 9
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        runlogs.save_paired(records, f"{tmp_path}/mine")


def test_folders_of_records_are_listed_by_few_tasks(spark, tmp_path):
    rows = [(0, str(n), side, 1.0) for n in range(60) for side in (True, False)]
    runlogs.save_paired(paired_records(spark, rows), f"{tmp_path}/records")
    context, group = spark.sparkContext, f"listing-{tmp_path}"
    context.setJobGroup(group, "listing")
    try:
        found = runlogs.load_paired(spark, f"{tmp_path}/records")
        tracker = context.statusTracker()
        stages = [stage for job in tracker.getJobIdsForGroup(group) for stage in tracker.getJobInfo(job).stageIds]
        tasks = [tracker.getStageInfo(stage).numTasks for stage in stages]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 8
    assert found.count() == 60


def test_runs_are_appended_by_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/edges"
    rows = spark.range(60).select(
        (F.col("id") % 20).cast("string").alias("run_id"), F.col("id").alias("seq"), F.col("id").alias("source"),
        (F.col("id") + 1).alias("target"), F.lit("operation").alias("event_type"),
        F.lit("mapVertices").alias("event_name"), F.create_map(F.lit("i"), F.lit("1")).alias("params"),
    )
    for _ in range(2):
        tables.append_runs(rows, path)
    assert len(writers(path)) > 1
    stored = tables.stored_runs(spark, path, tables.PROV_EDGES)
    assert sorted(row["seq"] for row in stored.collect()) == list(range(60))


@pytest.mark.parametrize("most", [3, 20_000])
def test_records_are_read_so_many_runs_at_a_time(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(runlogs, "FOLDERS_PER_PASS", most)
    seen = []
    plain = runlogs._json_files
    monkeypatch.setattr(runlogs, "_json_files", lambda spark, paths: seen.append(len(paths)) or plain(spark, paths))
    names = ["run-1", "run-2", "run-[3]", "run-4 {a,b}", "run-5*", "run=6"]
    places = [f"experiment-{n}/{name}" for n in (1, 2) for name in names]
    outside = ["notes/experiment-9/run-8", "_old/experiment-3/run-1", "experiment-1/.run-7"]
    for place in places + outside:
        for side, seconds in (("true", 3.0), ("false", 2.0)):
            os.makedirs(f"{tmp_path}/{place}/lineage-{side}")
            with open(f"{tmp_path}/{place}/lineage-{side}/metrics.json", "w") as file:
                json.dump({"algorithm": "pr", "graph": "w", "metadata": {"duration": {"duration": seconds}}}, file)
    found = runlogs.load_paired(spark, str(tmp_path)).collect()
    assert len(found) == len(places) + 1 and len({row["run"] for row in found}) == len(found)
    assert {(row["with_lineage"], row["without_lineage"]) for row in found} == {(3.0, 2.0)}
    assert max(seen) <= most and (len(seen) > 1) == (most == 3)
    for root, runs in (("experiment-1", 6), ("experiment-*", 12), ("experiment-1/run-1", 1), ("notes", 1)):
        assert runlogs.load_paired(spark, f"{tmp_path}/{root}").count() == runs
    os.makedirs(f"{tmp_path}/nothing")
    assert runlogs.load_paired(spark, f"{tmp_path}/nothing").count() == 0
    with pytest.raises(AnalysisException):
        runlogs.load_paired(spark, f"{tmp_path}/missing").count()


def edges_of_runs(spark, runs, seqs):
    """Provenance edges ``(run, seq)``, for each of ``runs``, which may be None."""
    rows = [(run, seq, seq, seq + 1, "operation", "mapVertices", {"i": str(seq)}) for run in runs for seq in seqs]
    return spark.createDataFrame(rows, tables.PROV_EDGES)


def test_appended_runs_need_no_folder_each(spark, tmp_path):
    path = f"{tmp_path}/edges"
    first, second = [f"a{n}" for n in range(50)], [f"b{n}" for n in range(50)]
    for runs, seqs in ((first, (1, 2)), (second, (1,)), (first, (3, 4))):
        tables.append_runs(edges_of_runs(spark, runs, seqs), path)
    places = [place for place, _, files in os.walk(path) if any(name.endswith(".parquet") for name in files)]
    assert len(places) == 2  # the first folder is gone, as all of its runs were written again
    found = tables.stored_runs(spark, path, tables.PROV_EDGES).collect()
    expected = [(run, seq) for run in first for seq in (3, 4)] + [(run, 1) for run in second]
    assert sorted((row["run_id"], row["seq"]) for row in found) == sorted(expected)


def test_runs_of_several_appends_are_read_from_the_last(spark, tmp_path):
    path = f"{tmp_path}/edges"
    for runs, seqs in (
        (["a", "b", None], (1, 1)), (["b", "c"], (2,)), (["", "d"], (3,)), ([], ()), (["c", "b"], (4,)), (["a"], (5,)),
    ):
        tables.append_runs(edges_of_runs(spark, runs, seqs), path)
    stored = tables.stored_runs(spark, path, tables.PROV_EDGES)
    expected = [("a", 5), ("b", 4), ("c", 4), ("d", 3), (None, 3)]  # a run without a name has none either way
    assert sorted(((r["run_id"], r["seq"]) for r in stored.collect()), key=str) == sorted(expected, key=str)
    assert [(r["run_id"], r["params"]) for r in stored.filter("run_id = 'b'").collect()] == [("b", {"i": "4"})]


def test_a_failed_append_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/edges"
    rows = edges_of_runs(spark, ["a", "b"], (1,))
    tables.append_runs(rows, path)
    with pytest.raises(Exception, match="no such run"):
        tables.append_runs(rows.withColumn("seq", F.expr("CAST(raise_error('no such run') AS BIGINT)")), path)
    assert sorted(r["run_id"] for r in tables.stored_runs(spark, path, tables.PROV_EDGES).collect()) == ["a", "b"]
    assert len(os.listdir(path)) == 1


def test_stored_formats_read_a_table(spark, monkeypatch):
    seen = []
    plain = queries.write_snapshot

    def write(vertices, path, storage_format):
        seen.append(is_scan(vertices))
        plain(vertices, path, storage_format)

    monkeypatch.setattr(queries, "write_snapshot", write)
    queries.QUERIES["snapshot_formats"](spark, SF)
    assert seen == [True] * len(queries.STORED_FORMATS)


def test_graph_on_the_tables_of_its_preparation(spark):
    ready = PreparedGraph(views.part_seq(spark, SF))
    graph = queries._on_tables(ready)
    assert is_scan(graph.edges) and is_scan(graph.vertices) and graph.listed is None
    assert sorted(graph.edges.collect()) == sorted(ready.graph.edges.collect())
    assert sorted(graph.vertices.collect()) == sorted(ready.graph.vertices.collect())
    ready.release()


@pytest.mark.parametrize("name", ["snapshot_edges", "verified_result"])
def test_traced_graph_is_on_tables(spark, monkeypatch, name):
    made = []
    plain = queries._on_tables
    monkeypatch.setattr(queries, "_on_tables", lambda ready: made.append(plain(ready)) or made[-1])
    queries.QUERIES[name](spark, SF)
    assert len(made) == 1 and made[0].edges_stored


@pytest.mark.parametrize("name", ["recorded_runs", "recorded_messages"])
def test_recorded_runs_share_a_stored_graph(spark, monkeypatch, name):
    seen = []
    plain = queries.run

    def run(spark, graph, request):
        seen.append(graph.edges_stored and is_scan(graph.edges) and is_scan(graph.vertices))
        return plain(spark, graph, request)

    monkeypatch.setattr(queries, "run", run)
    queries.QUERIES[name](spark, SF)
    assert seen == [True, True]


def test_first_ranks_are_joined_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "SMALL_EDGES_PER_PARTITION", 1)
    session = ProvenanceSession(
        spark, storage=True, directory=str(tmp_path), run_id="r", capture=capture_for("CombinedPruning", "PageRank")
    )
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    PropertyGraph.from_edges(edges).with_session(session).pagerank(1)
    session.flush()
    first = min(node for node, path in session.stored().items())
    assert len(writers(session.locations[first])) > 1
    rows = session.snapshots().filter(F.col("node_id") == first).collect()
    assert sorted((row["id"], row["value"]) for row in rows) == [(n, 1) for n in range(200)] + [(200, None)] or \
        sorted((row["id"], int(row["value"])) for row in rows) == [(n, 1) for n in range(200)]


def test_metrics_are_merged_in_bounded_tasks(spark, monkeypatch):
    def known(text):  # no literal, which the planner would leave out of the keys
        return F.when(F.col("id") >= 0, text)

    rows = spark.range(300).select(
        (F.col("id") % 50).cast("string").alias("run_id"), known("edge").alias("owner"), (F.col("id") % 3).alias("owner_id"),
        known("time").alias("kind"), known("operationTime").alias("name"),
        (F.col("id") % 100).cast("double").alias("value"), known("ns").alias("unit"),
    )
    monkeypatch.setattr(tables, "ROWS_PER_PARTITION", 10)
    found = tables.metric_totals(rows)
    assert found.rdd.getNumPartitions() >= 30
    got = {row["run_id"]: (row["observations"], row["total"]) for row in found.collect()}
    seen = {(n % 50, n % 3, n % 100) for n in range(300)}
    assert got == {
        str(run): (sum(r == run for r, _, _ in seen), float(sum(v for r, _, v in seen if r == run))) for run in range(50)
    }


def test_candidates_of_triangles_are_no_rows_of_their_own(spark, monkeypatch):
    seen = []
    plain = clustering._close
    monkeypatch.setattr(clustering, "_close", lambda *given: seen.append(plain(*given)) or seen[-1])
    edges = [(a, b) for a in range(12) for b in range(12) if (a * b + a) % 5 < 2]
    graph = PropertyGraph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert graph.lcc().vertices.count() == 12
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    keys = re.findall(r"Join \[([^]]*)\], \[([^]]*)\]", plan)
    assert len(keys) == 2 and not any(re.search(r"\bz#", left + right) for left, right in keys)
    assert plan.count("ShuffledHashJoin") == 2


@pytest.mark.parametrize("name", ["pagerank", "wcc", "sssp"])
def test_rounds_move_messages_alone(spark, monkeypatch, name):
    monkeypatch.setattr(layout, "SMALL_EDGES_PER_PARTITION", 1)
    monkeypatch.setattr(layout, "BUCKETED_STATE_ROWS", 0)
    plans = {}
    plain = Workspace.write_bucketed

    def write(space, table, df, *args, **kwargs):
        if table.startswith("round="):
            plans[table] = df._jdf.queryExecution().executedPlan().toString()
        return plain(space, table, df, *args, **kwargs)

    monkeypatch.setattr(Workspace, "write_bucketed", write)
    edges = spark.range(60).select(
        F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 60).alias("dst"), F.lit(1.0).alias("attr")
    )
    graph = PropertyGraph.from_edges(edges)
    found = {"pagerank": lambda: graph.pagerank(3), "wcc": lambda: graph.wcc(3), "sssp": lambda: graph.sssp(1)}[name]()
    assert found.vertices.count() == 60
    assert plans and all(plan.count("Exchange hashpartitioning") == 1 for plan in plans.values())


def test_a_vertex_without_id_takes_part_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(layout, "BUCKETED_STATE_ROWS", 0)

    def results(nothing):
        rows = [(1, 2, 1.0), (2, nothing, 1.0), (nothing, 3, 1.0), (3, 1, 2.0), (1, nothing, 5.0), (4, nothing, 1.0)]
        graph = PropertyGraph.from_edges(spark.createDataFrame(rows, "src bigint, dst bigint, attr double"))
        ranks = {row["id"]: round(row["attr"], 9) for row in graph.pagerank(4).vertices.collect()}
        return {99 if node is None else node: rank for node, rank in ranks.items()}, graph

    (with_null, graph), (with_id, _) = results(None), results(99)
    # a vertex without id gets ranks, but no join finds it as a sender
    assert with_null.keys() == with_id.keys() and with_null[99] > min(with_null.values())
    assert {row["id"] for row in graph.sssp(1).vertices.collect()} == {1, 2, 3, 4, None}
    assert {row["id"]: row["attr"] for row in graph.sssp(1).vertices.collect()}[None] == 2.0


@pytest.mark.parametrize("max_deltas", [0, 16])
def test_no_id_is_lost_after_sparse_rounds(spark, monkeypatch, max_deltas):
    # one sender, so sparse, then a wide round, in which the vertex without id gets a shorter way
    monkeypatch.setattr(rounds, "MOST_DELTAS", max_deltas)
    monkeypatch.setattr(layout, "BUCKETED_STATE_ROWS", 0)
    rows = [(0, 1, 1.0), (1, 2, 1.0)]
    rows += [(2, n, 1.0) for n in range(3, 203)] + [(n, None, 1.0) for n in range(3, 203)]
    graph = PropertyGraph.from_edges(
        spark.createDataFrame(rows, "src bigint, dst bigint, attr double"),
        spark.range(1000).select("id"),
    )
    found = {row["id"]: row["attr"] for row in graph.sssp(0).vertices.collect()}
    assert found[None] == 4.0 and found[202] == 3.0 and found[999] == float("inf")


def test_bucketed_states_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(layout, "SMALL_EDGES_PER_PARTITION", 20)
    _, _, graph = random_graph(spark, 2)

    def results():
        found = [graph.bfs(0), graph.sssp(0), graph.wcc(), graph.wcc(2), graph.pagerank(5)]
        return [{row["id"]: row["attr"] for row in each.vertices.collect()} for each in found]

    plain = results()
    monkeypatch.setattr(layout, "BUCKETED_STATE_ROWS", 0)
    for share in (100, 2):
        monkeypatch.setattr(rounds, "SPARSE_SHARE", share)
        *values, ranks = results()
        assert values == plain[:-1] and ranks == pytest.approx(plain[-1])
