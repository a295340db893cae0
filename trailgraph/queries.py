"""The registered queries: name to ``(spark, sf_dir) -> DataFrame``.

Every query reads whole test tables.  Computed doubles are rounded where their
last digits depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailgraph import views
from trailgraph.functions import text
from trailgraph.algorithms.traversal import UNREACHED_DEPTH
from trailgraph.graph import PropertyGraph
from trailgraph.operators.aggregate import Merge, Send
from trailgraph.operators.joins import verify_result
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.provenance import export, tables
from trailgraph.provenance.events import PREGEL_ITERATION
from trailgraph.provenance.record import RunRequest, run
from trailgraph.provenance.session import (
    CaptureFilter,
    DeltaPredicate,
    GraphPredicate,
    Hook,
    ProvenanceSession,
)
from trailgraph.provenance.setups import capture_for, reached, updates_vertices, with_flags
from trailgraph.reports import coverage, filters, overhead, tables as reports
from trailgraph.sinks.results import result_places, save_report, save_result
from trailgraph.sinks.snapshots import (
    StorageFormat,
    read_snapshots_of,
    snapshot_sizes,
    write_snapshot,
)
from trailgraph.sources import descriptors, graphs, runlogs
from trailgraph.sources.runlogs import normalised_runs
from trailgraph.workspace import Workspace

#: Formats that need no further package.
STORED_FORMATS = [
    "TextFile()", "TextFile(true)", "ObjectFile()", "ParquetFile()", "ORCFile()", "CSVFile()",
    "CSVFile(true)", "JSONFormat()", "JSONFormat(true)",
]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(name, digits).alias(name) for name in names]


# graphs and their operators


@query
def edge_list(spark, sf_dir):
    return views.part_seq(spark, sf_dir).edges


@query
def graph_vertices(spark, sf_dir):
    return views.part_seq(spark, sf_dir).vertices


@query
def num_vertices(spark, sf_dir):
    return spark.createDataFrame([(views.cust_supp(spark, sf_dir).num_vertices(),)], "num_vertices bigint")


@query
def out_degrees(spark, sf_dir):
    return views.part_seq(spark, sf_dir).out_degrees()


@query
def vertices_minus_dangling(spark, sf_dir):
    g = views.cust_supp(spark, sf_dir).stored()
    return g.vertices_minus(g.out_degrees())


@query
def map_vertices(spark, sf_dir):
    return views.part_graph(spark, sf_dir).map_vertices("id * 10 + attr").vertices


@query
def map_edges(spark, sf_dir):
    return views.part_seq(spark, sf_dir).map_edges("attr + src - dst").edges.select(
        "src", "dst", *rounded("attr")
    )


@query
def map_triplets_invdeg(spark, sf_dir):
    g = views.part_seq(spark, sf_dir).stored()
    with_degree = g.outer_join_vertices(g.out_degrees(), F.coalesce("new", F.lit(0)))
    return with_degree.map_triplets("1.0D / src_attr", ends=("src",)).edges


@query
def triplets(spark, sf_dir):
    return views.part_graph(spark, sf_dir).stored().triplets()


@query
def join_vertices(spark, sf_dir):
    g = views.part_graph(spark, sf_dir).stored()
    return g.join_vertices(g.out_degrees().filter("attr > 3"), "attr * 1000 + new").vertices


@query
def outer_join_vertices(spark, sf_dir):
    g = views.part_graph(spark, sf_dir).stored()
    return g.outer_join_vertices(g.out_degrees(), F.coalesce("new", F.lit(-1))).vertices


@query
def inner_join_vertices(spark, sf_dir):
    g = views.cust_supp(spark, sf_dir).stored().map_vertices("id % 7")
    dangling = g.vertices_minus(g.out_degrees())
    return g.inner_join_vertices(dangling)


@query
def remove_self_edges(spark, sf_dir):
    return views.part_seq(spark, sf_dir).remove_self_edges().edges


@query
def subgraph(spark, sf_dir):
    g = views.part_graph(spark, sf_dir).stored()
    kept = g.subgraph("attr > 10", "attr > 2000 AND src_attr <= dst_attr")
    return kept.edges


@query
def subgraph_vertices(spark, sf_dir):
    return views.part_graph(spark, sf_dir).subgraph("attr > 10").vertices


@query
def canonical_edges(spark, sf_dir):
    return views.part_seq(spark, sf_dir).canonical_edges(F.max).edges


def _texts(lists: DataFrame, name: str, item: Callable[[Column], Column]) -> DataFrame:
    """Lists as text, for a comparison that does not depend on array types."""
    return lists.select("id", "part", F.array_join(F.transform(name, item), ",").alias(name))


@query
def collect_edges(spark, sf_dir):
    found = views.cust_supp(spark, sf_dir).stored().collect_edges("either", part_ids=1000)
    return _texts(
        found,
        "edges",
        lambda e: F.concat_ws(
            ":", e["src"], e["dst"], F.round(e["attr"] * 100).cast("bigint")
        ),
    )


@query
def collect_neighbors(spark, sf_dir):
    found = views.part_graph(spark, sf_dir).stored().collect_neighbors("out", part_ids=1000)
    return _texts(found, "neighbors", lambda n: F.concat_ws(":", n["id"], n["attr"]))


@query
def aggregate_messages_sum(spark, sf_dir):
    g = views.part_graph(spark, sf_dir).stored()
    sends = [Send("dst", "src_attr", "src_attr > dst_attr"), Send("src", "dst_attr * 2")]
    return g.aggregate_messages(sends, F.sum)


@query
def aggregate_messages_gcd(spark, sf_dir):
    """The greatest common divisor of the senders, which no built-in aggregate gives."""

    def divisor(values, starts):
        import numpy as np

        return np.gcd.reduceat(values.to_numpy(zero_copy_only=False), starts)

    g = views.part_seq(spark, sf_dir).stored()
    return g.aggregate_messages([Send("dst", "src")], Merge(divisor), ends=())


@query
def aggregate_messages_min(spark, sf_dir):
    g = views.part_seq(spark, sf_dir)
    return g.aggregate_messages([Send("dst", "attr")], F.min, ends=())


# algorithms


def _first_id(ready: PreparedGraph) -> int:
    return ready.counts["smallest_id"]


def _on_tables(ready: PreparedGraph) -> PropertyGraph:
    """The graph, without attributes of vertices, on the tables that were made of
    it: until these are released, reading it computes no edge again."""
    return replace(
        ready.graph, vertices=ready.vertices.select("id"), edges=ready.edges, listed=None, edges_stored=True
    )


def _run(graph: PropertyGraph, algorithm) -> DataFrame:
    """The vertices of ``algorithm(graph, prepared)``."""
    ready = PreparedGraph(graph)
    try:
        return algorithm(graph, ready).vertices
    finally:
        ready.release()


@query
def bfs_part_seq(spark, sf_dir):
    return _run(
        views.part_seq(spark, sf_dir), lambda g, p: g.bfs(_first_id(p), prepared=p)
    ).select("id", F.col("attr").alias("depth"))


@query
def sssp_part_seq(spark, sf_dir):
    found = _run(views.part_seq(spark, sf_dir), lambda g, p: g.sssp(_first_id(p), prepared=p))
    return found.select("id", F.round("attr", 4).alias("dist"))


@query
def sssp_line_seq(spark, sf_dir):
    """Most of this graph is out of reach: the distance shows as text."""
    found = _run(views.line_seq(spark, sf_dir), lambda g, p: g.sssp(_first_id(p), prepared=p))
    reachable = F.format_string("%.2f", "attr")
    return found.select(
        "id", F.when(reached("SSSP"), reachable).otherwise("infinity").alias("dist")
    )


@query
def wcc_line_seq(spark, sf_dir):
    return _run(views.line_seq(spark, sf_dir), lambda g, p: g.wcc(prepared=p)).select(
        "id", F.col("attr").alias("component")
    )


@query
def wcc_line_seq_3_rounds(spark, sf_dir):
    return _run(views.line_seq(spark, sf_dir), lambda g, p: g.wcc(3, prepared=p)).select(
        "id", F.col("attr").alias("component")
    )


@query
def pagerank_line_seq_10(spark, sf_dir):
    return _run(views.line_seq(spark, sf_dir), lambda g, p: g.pagerank(10, prepared=p)).select(
        "id", F.round("attr", 10).alias("rank")
    )


@query
def pagerank_part_seq_5(spark, sf_dir):
    return _run(views.part_seq(spark, sf_dir), lambda g, p: g.pagerank(5, prepared=p)).select(
        "id", F.round("attr", 10).alias("rank")
    )


@query
def cdlp_part_seq_3(spark, sf_dir):
    return _run(views.part_seq(spark, sf_dir), lambda g, p: g.cdlp(3, prepared=p)).select(
        "id", F.col("attr").alias("label")
    )


@query
def lcc_part_seq(spark, sf_dir):
    return _run(views.part_seq(spark, sf_dir), lambda g, p: g.lcc(prepared=p)).select(
        "id", F.round("attr", 10).alias("coeff")
    )


@query
def pregel_max_value(spark, sf_dir):
    """The largest part size from which each part is reached."""

    def largest(g: PropertyGraph, ready: PreparedGraph) -> PropertyGraph:
        return g.pregel(
            F.lit(-1).cast("bigint"),
            lambda _, attr, message: F.greatest(attr, message),
            [Send("dst", "src_attr", "src_attr > dst_attr")],
            F.max,
            prepared=ready,
        )

    return _run(views.part_graph(spark, sf_dir), largest)


@query
def verified_result(spark, sf_dir):
    """Where distances of unit edges disagree with hops that were tampered with:
    every seventh id is missing, others are off by more or less than allowed."""
    ready = PreparedGraph(views.part_seq(spark, sf_dir))
    unit = _on_tables(ready).map_edges(F.lit(1.0))
    hops = ready.graph.bfs(_first_id(ready), prepared=ready).vertices
    distances = unit.sssp(_first_id(ready)).vertices
    never = F.when(F.col("attr") == 9223372036854775807, F.lit(float("inf")))
    off = F.when(F.col("id") % 7 == 1, 1e-6).when(F.col("id") % 7 == 2, 1e-9).otherwise(0.0)
    wrong = verify_result(
        distances.select("id", F.col("attr").alias("value")),
        hops.filter("id % 7 <> 0").select(
            "id",
            F.when(F.col("id") % 7 == 3, F.lit(float("inf")))
            .otherwise(never.otherwise(F.col("attr") + off)).alias("value"),
        ),
    )
    found = wrong.select("id", F.col("expected").isNull().alias("missing"))
    written = Workspace(spark, "verified").write("wrong", found).df
    ready.release()
    return written


# provenance of runs


def _traced_bfs(spark, sf_dir, **options) -> ProvenanceSession:
    session = ProvenanceSession(spark, run_id="bfs", **options)
    ready = PreparedGraph(views.part_seq(spark, sf_dir))
    _on_tables(ready).with_session(session).bfs(_first_id(ready), prepared=ready)
    ready.release()
    return session


def _lineage_dir(spark) -> str:
    return Workspace(spark, "lineage").path


@query
def bfs_rounds(spark, sf_dir):
    session = _traced_bfs(spark, sf_dir)
    found = tables.messages_per_round(session.prov_metrics(), session.prov_edges())
    return found.select("round", "messages")


@query
def observed_rounds(spark, sf_dir):
    """What a hook observes of every round, taken by the job that writes it."""
    reached_ = F.col("attr") < UNREACHED_DEPTH
    hook = Hook(
        event=lambda event: event.event_type == PREGEL_ITERATION,
        observe={
            "reached": F.count_if(reached_),
            "lowest": F.min("attr"),
            "deepest": F.max(F.when(reached_, F.col("attr"))),
        },
    )
    session = _traced_bfs(spark, sf_dir, hooks=(hook,))
    rounds = session.prov_edges().filter("event_type = 'pregelIteration'").select(
        F.col("target").alias("owner_id"), F.element_at("params", "i").cast("int").alias("round")
    )
    gauges = session.prov_metrics().filter(F.col("name").isin(list(hook.observe)))
    return gauges.join(rounds, "owner_id").select("round", "name", F.col("exact").cast("bigint").alias("value"))


@query
def prov_edges_bfs(spark, sf_dir):
    session = _traced_bfs(spark, sf_dir)
    return session.prov_edges().select(
        "seq", "source", "target", "event_type", export.relationship().alias("relationship")
    )


@query
def snapshot_bfs(spark, sf_dir):
    session = _traced_bfs(
        spark, sf_dir, storage=True, directory=_lineage_dir(spark), capture=CaptureFilter()
    )
    return session.snapshots().drop("run_id")


@query
def snapshot_bfs_pruned(spark, sf_dir):
    session = _traced_bfs(
        spark,
        sf_dir,
        storage=True,
        directory=_lineage_dir(spark),
        capture=capture_for("CombinedPruning", "BFS"),
        storage_format="CSVFile(true)",
    )
    return session.snapshots().drop("run_id")


@query
def snapshot_edges(spark, sf_dir):
    """The edges between the vertices that each round has reached."""
    session = _traced_bfs(
        spark, sf_dir, storage=True, directory=_lineage_dir(spark),
        capture=CaptureFilter(
            edge=updates_vertices("BFS"), data=GraphPredicate(vertex=reached("BFS")), edges=True
        ),
    )
    whole = tables.committed_snapshots(spark, session.directory).filter("with_edges")
    return session.snapshot_edges().join(whole, ["run_id", "node_id"], "left_semi").drop("run_id")


@query
def snapshot_pagerank_pruned(spark, sf_dir):
    session = ProvenanceSession(
        spark,
        storage=True,
        directory=_lineage_dir(spark),
        capture=capture_for("CombinedPruning", "PageRank"),
    )
    views.line_seq(spark, sf_dir).with_session(session).pagerank(3)
    return session.snapshots().select(
        "node_id", "event_name", "iteration", "id", F.round("value", 10).alias("value")
    )


@query
def delta_capture(spark, sf_dir):
    """Before each round, the depths of the parts of size 25 and more."""
    ids = views.table(spark, sf_dir, "part").filter("p_size >= 25").select(
        F.col("p_partkey").alias("id")
    )
    session = _traced_bfs(
        spark,
        sf_dir,
        storage=True,
        directory=_lineage_dir(spark),
        capture=CaptureFilter(edge=updates_vertices("BFS"), data=DeltaPredicate(ids)),
        storage_format="ORCFile()",
    )
    return session.snapshots().drop("run_id")


@query
def snapshot_size_totals(spark, sf_dir):
    """Bytes stored by a run that keeps the reached vertices of every graph."""
    session = _traced_bfs(
        spark,
        sf_dir,
        storage=True,
        directory=_lineage_dir(spark),
        capture=CaptureFilter(data=GraphPredicate(vertex=reached("BFS"))),
        storage_format="TextFile()",
    )
    return snapshot_sizes(spark, session.stored()).select("node_id", "size")


# provenance tables of many runs


@query
def prov_filter_joinvertices(spark, sf_dir):
    nodes = views.prov_nodes_log(spark, sf_dir)
    edges = views.prov_edges_log(spark, sf_dir)
    _, passing = tables.prov_filter(
        nodes,
        edges,
        "location IS NULL",
        tables.join_event_predicate(F.lit("BFS")),
    )
    return passing.drop("params")


@query
def prov_filter_nodes(spark, sf_dir):
    nodes = views.prov_nodes_log(spark, sf_dir)
    edges = views.prov_edges_log(spark, sf_dir)
    kept, _ = tables.prov_filter(
        nodes, edges, "location IS NOT NULL", tables.nothing()
    )
    return kept


@query
def prov_node_by_id(spark, sf_dir):
    nodes = views.prov_nodes_log(spark, sf_dir)
    return tables.node_by_id(nodes, "7", 2)


@query
def capture_decision(spark, sf_dir):
    return tables.capture_decision(
        views.prov_edges_log(spark, sf_dir),
        views.prov_nodes_log(spark, sf_dir),
        "event_name <> 'mapVertices'",
    )


@query
def capture_decision_by_metric(spark, sf_dir):
    """Decisions between graphs with many active messages, stored ones only if late."""
    nodes = tables.with_metrics(
        views.prov_nodes_log(spark, sf_dir), views.prov_metrics_log(spark, sf_dir), ["activeMessages"]
    )
    return tables.capture_decision(
        views.prov_edges_log(spark, sf_dir), nodes, tables.everything(),
        "activeMessages > 10 AND (location IS NULL OR node_id > 2)",
    )


@query
def appended_runs(spark, sf_dir):
    """A run per user, appended in two parts, one of them twice."""
    number = F.col("event_id")
    log = views.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), number.alias("seq"), number.alias("source"),
        (number + 1).alias("target"), F.lit("operation").alias("event_type"),
        F.col("event_type").alias("event_name"), F.create_map(F.lit("i"), number.cast("string")).alias("params"),
    )
    path = f"{Workspace(spark, 'appended').path}/edges"
    even = F.col("run_id").cast("bigint") % 2 == 0
    for part in (even, ~even, even):
        tables.append_runs(log.filter(part), path)
    return tables.stored_runs(spark, path, tables.PROV_EDGES).drop("params")


@query
def typed_metric_totals(spark, sf_dir):
    """Counters beyond what a double holds, and gauges that are texts."""
    events = views.table(spark, sf_dir, "events")
    head = [F.col("user_id").cast("string").alias("run_id"), F.lit("node").alias("owner"),
            F.col("event_id").alias("owner_id")]
    exact = F.col("event_id").cast("decimal(19,0)") * F.lit(9007199254740993).cast("decimal(16,0)")
    none = F.lit(None)
    counters = events.select(
        *head, F.lit("counter").alias("kind"), F.lit("bytes").alias("name"), exact.cast("double").alias("value"),
        none.cast("string").alias("unit"), exact.cast("decimal(38,0)").alias("exact"), none.cast("string").alias("text"),
    )
    gauges = events.select(
        *head, F.lit("gauge").alias("kind"), F.lit("state").alias("name"), none.cast("double").alias("value"),
        none.cast("string").alias("unit"), none.cast("decimal(38,0)").alias("exact"), F.col("event_type").alias("text"),
    )
    found = tables.metric_totals(counters.unionByName(gauges))
    return found.select(
        "run_id", "kind", "name", "observations", "exact_total", "exact_highest", "first_text", "last_text"
    )


@query
def metric_totals(spark, sf_dir):
    totals = tables.metric_totals(views.prov_metrics_log(spark, sf_dir))
    return totals.select(
        "run_id", "owner", "kind", "name", "observations", *rounded("total", digits=4),
        "lowest", "highest",
    )


@query
def counter_values(spark, sf_dir):
    """A counter per user: up at a purchase or signup, down at an error."""
    events = views.table(spark, sf_dir, "events")
    up = F.col("event_type").isin("purchase", "signup")
    delta = F.when(F.col("event_type") == "error", -1).when(up, 1).otherwise(0)
    deltas = events.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.lit("steps").alias("name"),
        delta.cast("bigint").alias("delta"),
    )
    return tables.counter_values(deltas)


@query
def prov_json_lines(spark, sf_dir):
    return export.json_edges(
        views.prov_edges_log(spark, sf_dir), views.prov_metrics_log(spark, sf_dir)
    ).drop("part")


@query
def prov_json_nodes(spark, sf_dir):
    return export.json_nodes(views.prov_nodes_log(spark, sf_dir))


@query
def prov_json_node_metrics(spark, sf_dir):
    return export.json_node_metrics(views.prov_metrics_log(spark, sf_dir))


@query
def prov_dot_lines(spark, sf_dir):
    return export.dot_lines(
        views.prov_nodes_log(spark, sf_dir), views.prov_edges_log(spark, sf_dir)
    )


# run-log reports


_PER_SETUP = ["setup", *reports.PAIR]


def _runs_of(spark, sf_dir, *setups: str) -> DataFrame:
    return views.run_log(spark, sf_dir).filter(F.col("setup").isin(*setups))


def _result_sizes(spark, sf_dir) -> DataFrame:
    return views.dataset_size_log(spark, sf_dir).withColumnRenamed("kind", "algorithm")


@query
def run_normalised(spark, sf_dir):
    runs = normalised_runs(views.record_log(spark, sf_dir), views.dataset_log(spark, sf_dir))
    return runs.withColumn("duration_s", F.round("duration_s", 5))


@query
def setup_flags(spark, sf_dir):
    runs = with_flags(views.run_log(spark, sf_dir))
    return runs.groupBy("setup", "tracing", "storage").agg(F.count("run_nr").alias("runs"))


@query
def run_stats(spark, sf_dir):
    found = reports.statistics(views.run_log(spark, sf_dir), "duration_s", _PER_SETUP)
    return found.select("setup", "algorithm", "dataset", *rounded("min", "mean", "max", "std"))


@query
def duration_table(spark, sf_dir):
    return reports.duration_table(views.run_log(spark, sf_dir), keys=_PER_SETUP)


@query
def size_table(spark, sf_dir):
    return reports.size_table(views.run_log(spark, sf_dir), keys=_PER_SETUP)


@query
def dataset_sizes(spark, sf_dir):
    return reports.dataset_sizes(views.dataset_size_log(spark, sf_dir))


@query
def group_summary(spark, sf_dir):
    found = reports.group_summary(views.run_log(spark, sf_dir))
    return found.withColumn("median_duration", F.round("median_duration", 6))


@query
def run_overhead(spark, sf_dir):
    found = overhead.duration_overhead(
        _runs_of(spark, sf_dir, *views.SETUPS[1:]), _runs_of(spark, sf_dir, "Baseline")
    )
    return found.select("run_nr", "algorithm", "dataset", *rounded("overhead_duration"))


@query
def run_size_overhead(spark, sf_dir):
    found = overhead.size_overhead(
        views.run_log(spark, sf_dir), _result_sizes(spark, sf_dir)
    )
    return filters.storing(found).select("run_nr", "algorithm", "dataset", *rounded("overhead_size"))


@query
def run_blowup(spark, sf_dir):
    graphs = reports.dataset_sizes(views.dataset_size_log(spark, sf_dir))
    found = overhead.blowup(views.run_log(spark, sf_dir), graphs)
    return found.select("run_nr", "algorithm", "dataset", *rounded("blowup"))


def _labelled(spark, sf_dir) -> DataFrame:
    runs = _runs_of(spark, sf_dir, "CompleteProvenance")
    return runs.withColumn("storage_format", text.format_label("storage_format"))


@query
def format_compare(spark, sf_dir):
    found = overhead.format_comparison(_labelled(spark, sf_dir))
    return found.select(
        "run_nr", "algorithm", "dataset", "storage_format",
        *rounded("overhead_duration", "overhead_size"),
    )


@query
def format_order(spark, sf_dir):
    compared = overhead.format_comparison(_labelled(spark, sf_dir))
    found = overhead.format_order(compared, keys=["algorithm"])
    return found.select("algorithm", "storage_format", *rounded("mean"))


@query
def replaced_format(spark, sf_dir):
    """Runs in text replaced by the runs under data pruning, and counted."""
    replacement = _runs_of(spark, sf_dir, "DataGraphPruning")
    found = overhead.replace_format(_labelled(spark, sf_dir), replacement)
    return found.groupBy("storage_format").agg(
        F.count("run_nr").alias("runs"), F.sum("total_size").alias("total_size")
    )


def _scenarios(spark, sf_dir) -> DataFrame:
    return overhead.scenarios(views.run_log(spark, sf_dir), {s: s for s in views.SETUPS})


@query
def scenario_summary(spark, sf_dir):
    found = overhead.scenario_summary(_scenarios(spark, sf_dir))
    return found.select("scenario", "runs", *rounded("min", "q1", "median", "q3", "max"))


@query
def scenario_size_summary(spark, sf_dir):
    large = filters.large_enough(_scenarios(spark, sf_dir))
    found = overhead.scenario_summary(large, "total_size")
    return found.select("scenario", "runs", "min", *rounded("q1", "median", "q3"), "max")


@query
def run_coverage(spark, sf_dir):
    """An algorithm and setup come up every 24 runs of the log, which numbers their
    repetitions; as many as the highest are planned."""
    repetition = F.floor(F.col("run_nr") / 24) + 1
    runs = views.run_log(spark, sf_dir).withColumn("run_nr", repetition)
    numbers = runs.agg(F.max("run_nr").alias("repetitions"))
    planned = coverage.planned_runs(
        views.dataset_log(spark, sf_dir), ["BFS", "PageRank", "WCC"], views.SETUPS, views.FORMATS,
        repetitions=numbers.first()["repetitions"] or 1,
    )
    return coverage.missing_runs(planned, runs, statuses=("SUCCESS",))


@query
def messages_per_round(spark, sf_dir):
    return reports.messages_per_round(views.paired_log(spark, sf_dir))


@query
def iterations_per_dataset(spark, sf_dir):
    found = reports.iterations_per_dataset(views.paired_log(spark, sf_dir))
    return found.select("algorithm", "dataset", *rounded("mean", "std"))


@query
def paired_overhead(spark, sf_dir):
    found = overhead.paired_overhead(views.paired_log(spark, sf_dir))
    return found.select("algorithm", "dataset", *rounded("mean", "std"))


@query
def paired_overhead_per_round(spark, sf_dir):
    found = overhead.paired_overhead(views.paired_log(spark, sf_dir), per_iteration=True)
    return found.select("algorithm", "dataset", *rounded("mean", "std"))


def _other_setups(spark, sf_dir) -> DataFrame:
    return views.run_log(spark, sf_dir).filter("setup <> 'Baseline'")


@query
def overhead_describe(spark, sf_dir):
    """The overhead of every setup without outliers, and how many of them are left out."""
    keys = ("setup", "algorithm")
    compared = overhead.duration_overhead(
        _other_setups(spark, sf_dir), _runs_of(spark, sf_dir, "Baseline")
    ).withColumnRenamed("overhead_duration", "overhead")
    within = filters.within_bounds(compared)
    left = compared.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs")).join(
        within.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept")), list(keys)
    )
    described = overhead.describe_overhead(within, keys=keys)
    return described.join(left.select(*keys, (F.col("runs") - F.col("kept")).alias("left_out")), list(keys))


@query
def summed_baseline(spark, sf_dir):
    found = overhead.summed_baseline(
        _runs_of(spark, sf_dir, "Baseline"), _other_setups(spark, sf_dir), "duration_s"
    )
    return found.select("run_nr", "setup", "algorithm", "dataset", *rounded("overhead", digits=8))


def _paired_tree(spark, sf_dir, prefix: str = "") -> str:
    """A tree of records: each user is a run, with lineage and without."""
    user = F.col("user_id")
    events = views.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").cast("int").alias("rounds")
    )
    name = user.cast("string")
    rounds = F.transform(
        F.sequence(F.lit(1), F.col("rounds")), lambda i: F.struct(i.alias("idx"), i.cast("bigint").alias("messageCount"))
    )
    duration = F.when(F.col("lineage"), F.col("n") / 2).otherwise(F.col("n") / 4)
    records = events.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("lineage")).select(
        (user % 10).alias("experiment"), F.concat(F.lit(prefix), name).alias("run"), "lineage",
        F.concat(F.lit("A"), user % 3).alias("algorithm"), F.concat(F.lit("G"), user % 5).alias("graph"),
        F.struct(
            name.alias("lineageDirectory"),
            F.struct(duration.alias("duration"), F.lit("s").alias("unit")).alias("duration"),
            rounds.alias("iterations"),
        ).alias("metadata"),
    )
    root = f"{Workspace(spark, 'paired').path}/records"
    runlogs.save_paired(records, root)
    return root


@query
def paired_files(spark, sf_dir):
    """Runs with lineage next to their twins, from the files of each."""
    found = runlogs.load_paired(spark, _paired_tree(spark, sf_dir))
    run = F.regexp_replace("run", "experiment=|run=", "")
    return found.withColumn("run", run).drop("rounds")


@query
def storage_overhead(spark, sf_dir):
    """Bytes of snapshots over bytes of the plain result, of the first run of each
    algorithm and dataset that has snapshots."""
    sizes = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("lineage_id"), F.col("l_linenumber").cast("bigint").alias("size")
    )
    outputs = views.table(spark, sf_dir, "customer").groupBy(
        F.concat(F.lit("A"), F.col("c_custkey") % 3).alias("algorithm"),
        F.concat(F.lit("G"), F.col("c_custkey") % 5).alias("dataset"),
    ).agg(F.max("c_custkey").alias("without_lineage"))
    paired = runlogs.load_paired(spark, _paired_tree(spark, sf_dir, "r"))
    paired = paired.join(sizes.select("lineage_id").distinct(), "lineage_id", "left_semi")
    paired = paired.withColumn("run", F.regexp_extract("run", "run=(.*)", 1))
    found = overhead.storage_overhead(sizes, paired, outputs)
    return found.select("algorithm", "dataset", *rounded("fraction", digits=8))


@query
def report_filters(spark, sf_dir):
    """Runs per setup that are left after each kind of exclusion."""
    runs = views.run_log(spark, sf_dir)
    kept = filters.without_pair(runs, "WCC", "datagen-8_8-zf")
    kept = filters.not_too_long(filters.without_dataset(kept, "graph500-22"), longest=300)
    return kept.groupBy("setup").agg(
        F.count("run_nr").alias("runs"), F.max("duration_s").alias("longest")
    )


# files written from whole tables and read again


def _text_file(spark, lines: DataFrame, name: str) -> str:
    path = f"{Workspace(spark, 'files').path}/{name}"
    lines.select("line").write.text(path)
    return path


def _weighted_lines(edges: DataFrame) -> DataFrame:
    """``src dst weight`` lines; weights below 20000 are left away."""
    weight = F.when(F.col("attr") >= 20000, F.col("attr").cast("string"))
    ends = [F.col(end).cast("string") for end in ("src", "dst")]
    return edges.select(F.concat_ws(" ", *ends, weight).alias("line"))


@query
def text_edges(spark, sf_dir):
    lines = _weighted_lines(views.part_seq_edges(spark, sf_dir))
    return graphs.load_edges(spark, _text_file(spark, lines, "graph.e"))


@query
def text_vertices(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part")
    lines = parts.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("line"))
    return graphs.load_vertices(spark, _text_file(spark, lines, "graph.v"))


def _undirected(spark, sf_dir) -> PropertyGraph:
    """A graph in its three files; the descriptor says that it is undirected."""
    folder = Workspace(spark, "files").path
    _weighted_lines(views.part_seq_edges(spark, sf_dir)).write.text(f"{folder}/parts.e")
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("line"))
    parts.write.text(f"{folder}/parts.v")
    marked = parts.agg(F.lit("graph.parts.directed = false").alias("line"))
    marked.write.text(f"{folder}/parts.properties")
    return graphs.load_graph(spark, f"{folder}/parts", directed=None)


@query
def text_graph_edges(spark, sf_dir):
    return _undirected(spark, sf_dir).edges


@query
def text_graph_vertices(spark, sf_dir):
    return _undirected(spark, sf_dir).vertices.select("id")


@query
def text_descriptors(spark, sf_dir):
    """A descriptor per customer, its keys in no particular order."""
    customer = F.col("c_custkey").cast("string")
    values = {
        "meta.vertices": customer,
        "directed": F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false"),
        "algorithms": F.when(F.col("c_custkey") % 3 == 0, "bfs, pr, # wcc,").otherwise(" sssp,wcc"),
        "pr.damping-factor": F.format_string("0.%s", F.col("c_custkey") % 10),
    }
    lines = [
        F.concat(F.lit("graph.c"), customer, F.lit(f".{key} = "), value)
        for key, value in values.items()
    ]
    written = views.table(spark, sf_dir, "customer").select(
        F.explode(F.array(*lines, F.lit("# a comment"))).alias("line")
    )
    found = descriptors.load_datasets(spark, _text_file(spark, written, "all.properties"))
    return found.select(
        "graph", "n_vertices", "directed", F.array_join("algorithms", "|").alias("algorithms"),
        "pr_damping",
    )


@query
def text_expected(spark, sf_dir):
    """Sizes of parts, where every seventh is infinite."""
    size = F.when(F.col("p_partkey") % 7 == 0, "infinity").otherwise(F.col("p_size").cast("string"))
    lines = views.table(spark, sf_dir, "part").select(
        F.concat_ws(" ", F.col("p_partkey").cast("string"), size).alias("line")
    )
    return graphs.load_expected(spark, _text_file(spark, lines, "expected"))


@query
def result_file(spark, sf_dir):
    path = f"{Workspace(spark, 'files').path}/result"
    save_result(views.part_graph(spark, sf_dir).vertices, path)
    return graphs.load_expected(spark, path)


@query
def ordered_result(spark, sf_dir):
    """The lines of an ordered result, with their places in all of its files."""
    path = f"{Workspace(spark, 'files').path}/ordered"
    save_result(views.part_graph(spark, sf_dir).vertices, path, ordered=True)
    return result_places(spark, path).select("place", "line")


@query
def report_file(spark, sf_dir):
    path = f"{Workspace(spark, 'files').path}/report.csv"
    report = run_stats(spark, sf_dir)
    save_report(report, path)
    return spark.read.option("header", True).schema(report.schema).csv(path)


@query
def snapshot_formats(spark, sf_dir):
    """The graph of all parts, stored in every format that needs no package."""
    space = Workspace(spark, "files")
    vertices = space.write("vertices", views.part_graph(spark, sf_dir).vertices).df  # read once a format
    base = f"{space.path}/snapshots"
    found = []
    for number, name in enumerate(STORED_FORMATS):
        storage_format = StorageFormat.parse(name)
        path = f"{base}/run_id=all/node_id={number}"
        write_snapshot(vertices, path, storage_format)
        snapshot = read_snapshots_of(spark, [path], base, storage_format, "bigint")
        found.append(snapshot.select(F.lit(name).alias("storage_format"), "node_id", "id", "value"))
    return reduce(DataFrame.unionByName, found)


@query
def size_listing(spark, sf_dir):
    """Sizes of the snapshots of a run, among other files."""
    order = F.col("l_orderkey").cast("string")
    path = F.concat(F.lit("/lineage/"), order, F.lit("/"), F.col("l_linenumber").cast("string"))
    kind = F.when(F.col("l_linenumber") % 4 == 0, ".e").otherwise(".v")
    size = F.floor("l_extendedprice").cast("string")
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.concat(size, F.lit("  "), path, kind).alias("line")
    )
    return runlogs.load_sizes(spark, _text_file(spark, lines, "sizes"))


@query
def output_size_listing(spark, sf_dir):
    """Largest result files with lineage and without."""
    flag = F.when(F.col("setup") == "Baseline", "").otherwise("-lineage")
    name = F.concat("algorithm", F.lit("-"), "dataset", flag, F.lit(".txt"))
    lines = views.run_log(spark, sf_dir).select(
        F.concat(F.col("run_nr").cast("string"), F.lit(" /results/"), name).alias("line")
    )
    return runlogs.load_output_sizes(spark, _text_file(spark, lines, "output-sizes"))


def _recorded(spark, graph: PropertyGraph) -> str:
    """The folder of the records of two runs on ``graph``, the part sequence."""
    root = Workspace(spark, "records").path
    source = graph.vertices.agg(F.min("id")).first()[0]
    for number, algorithm, setup, parameters in (
        (1, "BFS", "CombinedPruning", {"source": source}),
        (2, "PageRank", "Tracing", {"num_iter": 3}),
    ):
        run(
            spark,
            graph,
            RunRequest(
                dataset="part-seq", algorithm=algorithm, setup=setup, parameters=parameters,
                output=f"{root}/experiment-{number}", lineage=f"{root}/lineage", run_nr=number,
            ),
        )
    return root


@query
def recorded_runs(spark, sf_dir):
    """Two runs, read back from the records that they wrote."""
    graph = views.part_seq(spark, sf_dir).stored()
    sizes = graph.vertices.agg(F.lit("part-seq").alias("graph"), F.count("id").alias("n_vertices"))
    found = runlogs.load_runs(spark, _recorded(spark, graph), sizes)
    return found.select(
        "experiment", "setup", "algorithm", "dataset", "run_nr", "storage_format", "n_vertices",
        "iterations", (F.col("total_size") > 0).alias("stored"),
    )


@query
def recorded_messages(spark, sf_dir):
    """Messages per graph of the recorded breadth-first search."""
    found = runlogs.load_metrics(spark, _recorded(spark, views.part_seq(spark, sf_dir).stored()))
    return found.filter("experiment = 'experiment-1' AND name = 'activeMessages'").select(
        F.col("value").cast("bigint").alias("messages")
    )


# text functions


@query
def human_size(spark, sf_dir):
    """Prices in cents as bytes, 64 times more per line number."""
    cents = F.floor(F.col("l_extendedprice") * 100).cast("bigint")
    scaled = F.expr("shiftleft(cents, (l_linenumber - 1) * 6)")
    return (
        views.table(spark, sf_dir, "lineitem")
        .withColumn("cents", cents)
        .select("l_orderkey", "l_linenumber", scaled.alias("bytes"))
        .withColumn("size", text.human_size("bytes"))
    )


@query
def human_duration(spark, sf_dir):
    """Prices in cents as milliseconds, and as seconds on a clock."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.human_duration(cents * 1_000_000).alias("duration"),
        text.clock("o_totalprice").alias("clock"),
    )


@query
def name_lists(spark, sf_dir):
    """The words of part names as a comma list, with one commented out."""
    words = F.concat(F.lit(" #"), F.regexp_replace("p_name", " +", " , "), F.lit(",, "), "p_brand")
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(text.name_list(words), "|").alias("names")
    )
