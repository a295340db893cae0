"""Times the headline queries and prints one JSON line.

The load (edge view, vertex table, edge layout) is timed on its own; the
algorithms are timed on the loaded graph, with and without tracing and capture,
because the published numbers time the algorithm call and not the load.  Each
setup is timed several times, in an order that moves on by one each time, after
a first run that is not timed; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from trailgraph import views  # noqa: E402
from trailgraph.plans.prepared import PreparedGraph  # noqa: E402
from trailgraph.provenance.session import ProvenanceSession  # noqa: E402
from trailgraph.provenance.setups import SETUPS, capture_for, flags  # noqa: E402
from trailgraph.queries import QUERIES  # noqa: E402
from trailgraph.workspace import Workspace, clear_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPETITIONS = int(os.environ.get("BENCH_REPETITIONS", "3"))
PLAIN = [
    "edge_list", "map_triplets_invdeg", "subgraph", "canonical_edges", "collect_neighbors",
    "aggregate_messages_sum", "prov_filter_joinvertices", "capture_decision", "metric_totals",
    "prov_json_lines", "run_normalised", "run_overhead", "format_compare", "scenario_summary",
    "run_coverage",
]
TRACED = {
    "bfs": ("BFS", lambda g, p: g.bfs(p.counts["smallest_id"], prepared=p)),
    "pagerank": ("PageRank", lambda g, p: g.pagerank(10, prepared=p)),
    "sssp": ("SSSP", lambda g, p: g.sssp(p.counts["smallest_id"], prepared=p)),
    "wcc": ("WCC", lambda g, p: g.wcc(prepared=p)),
}
UNTRACED = {
    "cdlp": lambda g, p: g.cdlp(5, prepared=p),
    "lcc": lambda g, p: g.lcc(prepared=p),
}


def timed(times: dict, name: str, action) -> None:
    started = time.perf_counter()
    action()
    times[name] = round(time.perf_counter() - started, 3)


def force(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def run_setup(spark, graph, prepared, setup: str, algorithm: str, call) -> None:
    tracing, storage = flags(setup)
    if tracing:
        session = ProvenanceSession(
            spark,
            storage=storage,
            directory=f"{Workspace(spark, 'bench-lineage').path}/snapshots",
            capture=capture_for(setup, algorithm),
        )
        graph = graph.with_session(session)
    force(call(graph, prepared).vertices)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    force(QUERIES["out_degrees"](spark, SF_DIR))  # start-up is not measured

    for name in PLAIN:
        timed(times, name, lambda: force(QUERIES[name](spark, SF_DIR)))

    graph = views.part_seq(spark, SF_DIR)
    prepared = PreparedGraph(graph)

    def load() -> None:
        prepared.counts
        prepared.outgoing.cold.count()
        prepared.both_ways.cold.count()

    timed(times, "load_part_seq", load)
    for name, (algorithm, call) in TRACED.items():
        setups = list(SETUPS)
        run_setup(spark, graph, prepared, setups[0], algorithm, call)
        taken: dict[str, list[float]] = {}
        for turn in range(REPETITIONS):
            for setup in setups[turn:] + setups[:turn]:
                one: dict[str, float] = {}
                timed(
                    one,
                    "run",
                    lambda: run_setup(spark, graph, prepared, setup, algorithm, call),
                )
                taken.setdefault(setup, []).append(one["run"])
        for setup in setups:
            times[f"{name}_{setup.lower()}"] = statistics.median(taken[setup])
    for name, call in UNTRACED.items():
        timed(times, name, lambda: force(call(graph, prepared).vertices))
    prepared.release()
    timed(times, "wcc_line_seq", lambda: force(QUERIES["wcc_line_seq"](spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    clear_session(spark)
    spark.stop()


if __name__ == "__main__":
    main()
