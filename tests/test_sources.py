"""Readers and sinks on written files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tests import example
from tests.example import graph, result
from trailgraph.operators.joins import verify_result
from trailgraph.provenance.record import RunRequest, run
from trailgraph.reports.overhead import storage_overhead
from trailgraph.reports.tables import messages_per_round
from trailgraph.sinks import results
from trailgraph.sinks.results import save_report, save_result
from trailgraph.sources import graphs, runlogs
from trailgraph.sources.descriptors import load_datasets

DESCRIPTOR = """
# a small graph
graph.tiny-1.vertex-file = tiny-1.v
graph.tiny-1.edge-file=tiny-1.e
graph.tiny-1.meta.vertices=4
graph.tiny-1.meta.edges = 3
graph.tiny-1.directed=false
graph.tiny-1.algorithms=bfs, pr,  #lcc, sssp ,wcc
graph.tiny-1.bfs.source-vertex=1
graph.tiny-1.pr.damping-factor=0.9
graph.tiny-1.pr.num-iterations=10
"""


def test_graph_files(spark, tmp_path):
    (tmp_path / "tiny-1.v").write_text("1\n2 \n 7\n")
    (tmp_path / "tiny-1.e").write_text("1 2 0.5\n2\t3\n\n 3  1 2.5 \n")
    (tmp_path / "tiny-1.properties").write_text(DESCRIPTOR)
    prefix = str(tmp_path / "tiny-1")
    g = graphs.load_graph(spark, prefix)
    edges = [(1, 2, 0.5), (2, 3, 0.0), (3, 1, 2.5)]
    assert sorted(map(tuple, g.edges.collect())) == edges
    assert sorted(r["id"] for r in g.vertices.collect()) == [1, 2, 3, 7]
    assert result(g.sssp(1)) == {1: 0.0, 2: 0.5, 3: 0.5, 7: math.inf}
    undirected = graphs.load_graph(spark, prefix, directed=None)
    assert undirected.edges.count() == 6


def test_descriptors(spark, tmp_path):
    (tmp_path / "a.properties").write_text(DESCRIPTOR)
    (tmp_path / "b.properties").write_text(
        DESCRIPTOR.replace("tiny-1", "other_2").replace("directed=false", "directed=true")
    )
    found = {r["graph"]: r for r in load_datasets(spark, f"{tmp_path}/*.properties").collect()}
    assert set(found) == {"tiny-1", "other_2"}
    tiny = found["tiny-1"]
    assert tiny["algorithms"] == ["BFS", "PageRank", "SSSP", "WCC"]
    assert (tiny["n_vertices"], tiny["n_edges"], tiny["directed"]) == (4, 3, False)
    assert (tiny["bfs_source"], tiny["pr_damping"], tiny["pr_iterations"]) == (1, 0.9, 10)
    assert tiny["cdlp_iterations"] is None and found["other_2"]["directed"]


def test_results_against_expected_files(spark, tmp_path):
    g = graph(spark)
    for name, expected, kind in (
        ("bfs", example.BFS, "bigint"), ("sssp", example.SSSP, "double")
    ):
        path = tmp_path / name
        lines = [
            f"{i} {'infinity' if v in (example.MAX, math.inf) else v}" for i, v in expected.items()
        ]
        path.write_text("\n".join(lines))
        wanted = graphs.load_expected(spark, str(path), kind)
        found = getattr(g, name)(1).vertices.withColumnRenamed("attr", "value")
        assert verify_result(found, wanted).count() == 0
    (tmp_path / "pr").write_text("1 1.477629166666667e-1\n")
    value = graphs.load_expected(spark, str(tmp_path / "pr"), "double").first()["value"]
    assert value == example.PAGERANK[1]


def test_result_and_report_sinks(spark, tmp_path):
    vertices = spark.createDataFrame([(1, 5), (2, 6)], "id long, attr long")
    save_result(vertices, f"{tmp_path}/result")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/result").collect()) == [
        "1 5", "2 6"
    ]
    save_report(vertices, f"{tmp_path}/report")
    back = spark.read.option("header", True).csv(f"{tmp_path}/report")
    assert back.columns == ["id", "attr"] and back.count() == 2


def inputs(setup, storage_format, run_nr):
    return {
        "config": "c", "vertices": "v", "edges": "e",
        "parameters": {
            "experimentID": "x", "dataset": "tiny-1", "algorithm": "BFS", "runNr": run_nr,
            "outputDir": "o", "lineageDir": "l", "setup": setup,
            "tracingEnabled": True, "storageEnabled": True, "storageFormat": storage_format,
            "applicationId": "a", "numExecutors": 7,
        },
    }


OUTPUTS = {
    "stdout": "", "stderr": "", "results": "r", "lineageDirectory": "l",
    "graph": {
        "nodes": [{"id": 0, "location": ""}],
        "edges": [
            {
                "source": 0, "target": 1, "relationship": "Operation(mapVertices)",
                "type": "operation",
                "metrics": {
                    "type": "ObservationSet",
                    "values": [[{
                        "type": "time", "name": "operationTime",
                        "value": {"amount": "12", "unit": "ns"},
                    }]],
                },
            },
            {
                "source": 0, "target": 1, "relationship": "PregelIteration(0)",
                "type": "pregelIteration",
                "metrics": {"type": "ObservationSet", "values": [[]]},
            },
        ],
    },
    "sizes": [
        {"graphID": 1, "size": 3_000_000_000, "location": "p"},
        {"graphID": 2, "size": 10, "location": "q"},
    ],
    "duration": {"amount": 2.5e9, "unit": "ns"},
    "metrics": [
        {
            "graphID": 1,
            "metrics": {
                "type": "ObservationSet",
                "values": [[{"type": "a.b.Gauge", "name": "activeMessages", "value": "4"}]],
            },
        }
    ],
}


def test_run_log(spark, tmp_path):
    (tmp_path / "d.properties").write_text(DESCRIPTOR)
    for name, record in (
        ("experiment-1", inputs("CompleteProvenance", "CSVFile(true)", 1)),
        ("experiment-2", inputs("Baseline", "ParquetFile()", 2)),
        ("experiment-3", inputs("Tracing", "TextFile()", 3)),
    ):
        folder = tmp_path / name / "provenance"
        folder.mkdir(parents=True)
        (folder / "inputs.json").write_text(json.dumps(record, indent=2))
        if name != "experiment-3":
            (folder / "outputs.json").write_text(json.dumps(OUTPUTS, indent=2))
    datasets = load_datasets(spark, f"{tmp_path}/*.properties")
    found = {r["run_nr"]: r for r in runlogs.load_runs(spark, str(tmp_path), datasets).collect()}
    assert set(found) == {1, 2}
    first = found[1]
    assert (first["setup"], first["storage_format"], first["compressed"]) == (
        "completeprovenance", "CSV-C", True
    )
    assert first["total_size"] == 3_000_000_010
    assert (first["iterations"], first["n_operations"], first["n_vertices"]) == (1, 1, 4)
    assert first["duration_s"] == 2.5
    assert found[2]["storage_format"] == "Parquet-C"
    metric = runlogs.load_metrics(spark, str(tmp_path)).first()
    assert (metric["kind"], metric["name"], metric["value"]) == ("gauge", "activeMessages", 4.0)


def test_older_listings(spark, tmp_path):
    (tmp_path / "checkpoints.txt").write_text(
        "10 B /data/run-a/0.v\n20 B /data/run-a/1.v\n5 B /data/run-a/1.e\n7 B /data/run-b/0.v\n"
    )
    sizes = runlogs.load_sizes(spark, f"{tmp_path}/checkpoints.txt")
    assert sorted((r["lineage_id"], r["iteration"], r["size"]) for r in sizes.collect()) == [
        ("run-a", 0, 10), ("run-a", 1, 20), ("run-b", 0, 7)
    ]
    (tmp_path / "outputs.txt").write_text(
        "100 B /out/pr-wiki-Talk.txt\n130 B /out/pr-wiki-Talk-lineage.txt\n"
    )
    outputs = runlogs.load_output_sizes(spark, f"{tmp_path}/outputs.txt")
    assert [tuple(r) for r in outputs.collect()] == [("pr", "wiki-Talk", 130, 100)]
    for number, (on, off) in enumerate([(3.0, 2.0), (1.0, 2.0)]):
        for flag, seconds in (("true", on), ("false", off)):
            folder = tmp_path / "experiment-1" / f"run-{number}" / f"lineage-{flag}"
            folder.mkdir(parents=True)
            rounds = [{"idx": 0, "messageCount": 9}] if flag == "true" else None
            record = {
                "algorithm": "pr", "graph": "wiki-Talk",
                "metadata": {
                    "lineageDirectory": "run-a", "iterations": rounds,
                    "duration": {"duration": seconds, "unit": "s"},
                },
            }
            (folder / "metrics.json").write_text(json.dumps(record))
    paired = runlogs.load_paired(spark, str(tmp_path))
    assert sorted((r["with_lineage"], r["without_lineage"]) for r in paired.collect()) == [
        (1.0, 2.0), (3.0, 2.0)
    ]
    assert messages_per_round(paired).select("round", "messages").distinct().collect() == [(1, 9)]
    assert storage_overhead(sizes, paired, outputs).first()["fraction"] == 0.3


def test_run_record(spark, tmp_path):
    request = RunRequest(
        "example", "BFS", "CombinedPruning", {"source": 1},
        f"{tmp_path}/out", f"{tmp_path}/lineage", storage_format="JSONFormat()",
    )
    record = run(spark, graph(spark), request)
    assert result(record.result) == example.BFS
    row = spark.read.json(f"{tmp_path}/out/run").first()
    assert (row["setup"], row["iterations"], row["status"]) == ("combinedpruning", 2, "SUCCESS")
    assert row["total_size"] > 0 and row["duration_s"] > 0
    assert json.loads(row["parameters"]) == {"source": 1}
    sizes = spark.read.json(f"{tmp_path}/out/sizes")
    assert sizes.agg(F.sum("size")).first()[0] == row["total_size"]
    assert spark.read.text(f"{tmp_path}/out/vertices").count() == 10
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/out/graph.dot").collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}"
    edges = spark.read.json(f"{tmp_path}/out/prov_edges")
    assert edges.filter("relationship = 'BFS(1)'").count() == 1


@pytest.mark.parametrize("setup", ["Baseline", "Tracing"])
def test_run_record_without_storage(spark, tmp_path, setup):
    request = RunRequest(
        "example", "PageRank", setup, {"num_iter": 2}, f"{tmp_path}/out", f"{tmp_path}/lineage"
    )
    run(spark, graph(spark), request)
    row = spark.read.json(f"{tmp_path}/out/run").first()
    assert (row["total_size"], row["iterations"]) == (0, 0 if setup == "Baseline" else 2)


def test_descriptor_without_direction(spark, tmp_path):
    (tmp_path / "g.e").write_text("1 2\n")
    (tmp_path / "g.v").write_text("1\n2\n")
    for content in ("# nothing\n", "graph.g.meta.edges = 1\n"):
        (tmp_path / "g.properties").write_text(content)
        with pytest.raises(ValueError, match="directed"):
            graphs.load_graph(spark, str(tmp_path / "g"), directed=None)


def test_results_in_order(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("id"), F.lit(1.5).alias("attr")).repartition(7)
    results.save_result(rows, str(tmp_path / "a"), ordered=True)
    ids = sorted(r["id"] for r in rows.collect())
    places = {r["place"]: r["line"] for r in results.result_places(spark, str(tmp_path / "a")).collect()}
    assert [places[k + 1] for k in range(5000)] == [f"{i} 1.5" for i in ids]
    assert results.misplaced(spark, str(tmp_path / "a")).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    results.save_result(rows, str(tmp_path / "many"), ordered=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "many").glob("part-*"))) > 1
    assert results.misplaced(spark, str(tmp_path / "many")).count() == 0
    again = {r["place"]: r["line"] for r in results.result_places(spark, str(tmp_path / "many")).collect()}
    assert again == places
    results.save_result(rows, str(tmp_path / "b"))
    assert {r["reason"] for r in results.misplaced(spark, str(tmp_path / "b")).collect()} >= {"falls"}
    (tmp_path / "c").mkdir()
    for name, ids in (("part-0", (1, 5, 9)), ("part-1", (8, 10)), ("part-2", (11,))):
        (tmp_path / "c" / name).write_text("".join(f"{i} x\n" for i in ids))
    assert [tuple(r) for r in results.misplaced(spark, str(tmp_path / "c")).collect()] == [("part-1", "overlaps")]
