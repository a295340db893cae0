"""A benchmark run: an algorithm under a setup, with its record written out."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailgraph.graph import PropertyGraph
from trailgraph.plans.prepared import PreparedGraph
from trailgraph.provenance.export import dot_lines, relationship
from trailgraph.provenance.session import ProvenanceSession
from trailgraph.provenance.setups import capture_for, flags
from trailgraph.sinks.results import save_result
from trailgraph.sinks.snapshots import snapshot_sizes


@dataclass(frozen=True)
class RunRequest:
    """What to run: the algorithm on a dataset under a setup."""

    dataset: str
    algorithm: str
    setup: str
    parameters: dict
    output: str
    lineage: str
    run_nr: int = 1
    storage_format: str = "TextFile()"


@dataclass(frozen=True)
class RunRecord:
    session: ProvenanceSession
    result: PropertyGraph
    nanos: int

    def sizes(self) -> DataFrame:
        """Bytes of every graph with metrics or a location."""
        measured = {m[1] for m in self.session.metrics if m[0] == "node"}
        known = measured | set(self.session.locations)
        return snapshot_sizes(
            self.session.spark, {node: self.session.locations.get(node, "") for node in known}
        )


def run(spark: SparkSession, graph: PropertyGraph, request: RunRequest) -> RunRecord:
    """Run the algorithm, timed, and save its result, run row, provenance tables,
    snapshot sizes and drawing below the output folder.

    The record that ``sources.runlogs.load_runs`` reads goes to its ``provenance``
    folder; for that, the output folder is named ``experiment-<id>``.
    """
    tracing, storage = flags(request.setup)
    session = ProvenanceSession(
        spark,
        tracing=tracing,
        storage=storage,
        capture=capture_for(request.setup, request.algorithm),
        directory=request.lineage,
        storage_format=request.storage_format,
    )
    prepared = PreparedGraph(graph)
    prepared.counts  # the load is not part of the measured time
    started = time.perf_counter_ns()
    result = _call(graph.with_session(session), request, prepared)
    record = RunRecord(session, result, time.perf_counter_ns() - started)
    save_result(result.vertices, f"{request.output}/vertices")
    session.flush()
    _save(spark, request, record, graph)
    _save_record(spark, request, record)
    prepared.release()
    return record


def _call(graph: PropertyGraph, request: RunRequest, prepared: PreparedGraph) -> PropertyGraph:
    methods = {
        "BFS": graph.bfs,
        "SSSP": graph.sssp,
        "WCC": graph.wcc,
        "PageRank": graph.pagerank,
        "CDLP": graph.cdlp,
        "LCC": graph.lcc,
    }
    return methods[request.algorithm](**request.parameters, prepared=prepared)


def _save(spark: SparkSession, request: RunRequest, record: RunRecord, graph) -> None:
    session = record.session
    output = request.output
    edges, nodes, sizes = session.prov_edges(), session.prov_nodes(), record.sizes()
    edges.withColumn("relationship", relationship()).write.json(f"{output}/prov_edges")
    nodes.write.json(f"{output}/prov_nodes")
    session.prov_metrics().write.json(f"{output}/prov_metrics")
    sizes.write.json(f"{output}/sizes")
    dot_lines(nodes, edges).coalesce(1).sortWithinPartitions("part").select("line").write.text(
        f"{output}/graph.dot"
    )
    stored = sizes.agg(F.sum("size").alias("total_size"))
    kinds = [edge.event.event_type for edge in session.edges]
    stored.select(
        F.lit(session.run_id).alias("run_id"),
        F.lower(F.lit(request.setup)).alias("setup"),
        F.lit(request.algorithm).alias("algorithm"),
        F.lit(request.dataset).alias("dataset"),
        F.lit(request.run_nr).alias("run_nr"),
        F.lit(request.storage_format).alias("storage_format"),
        F.lit(session.tracing).alias("tracing"),
        F.lit(session.storage).alias("storage"),
        F.coalesce("total_size", F.lit(0)).alias("total_size"),
        F.lit(kinds.count("pregelIteration")).alias("iterations"),
        F.lit(kinds.count("operation")).alias("n_operations"),
        F.lit(record.nanos / 1e9).alias("duration_s"),
        F.lit(json.dumps(request.parameters)).alias("parameters"),
        F.lit(request.output).alias("output"),
        F.lit(request.lineage).alias("lineage"),
        F.lit(spark.sparkContext.applicationId).alias("application_id"),
        F.lit("SUCCESS").alias("status"),
    ).write.json(f"{output}/run")


def _save_record(spark: SparkSession, request: RunRequest, record: RunRecord) -> None:
    """``inputs.json`` and ``outputs.json``: what went in and what came out."""
    session = record.session
    inputs = {
        "parameters": {
            "experimentID": session.run_id,
            "dataset": request.dataset,
            "algorithm": request.algorithm,
            "runNr": request.run_nr,
            "outputDir": request.output,
            "lineageDir": request.lineage,
            "setup": request.setup,
            "tracingEnabled": session.tracing,
            "storageEnabled": session.storage,
            "storageFormat": request.storage_format,
            "applicationId": spark.sparkContext.applicationId,
        },
    }
    nodes = sorted({node for edge in session.edges for node in (edge.source, edge.target)})
    measured = sorted({metric[1] for metric in session.metrics if metric[0] == "node"})
    outputs = {
        "results": f"{request.output}/vertices",
        "lineageDirectory": request.lineage,
        "graph": {
            "nodes": [{"id": n, "location": session.locations.get(n) or ""} for n in nodes],
            "edges": [
                {
                    "source": edge.source,
                    "target": edge.target,
                    "relationship": str(edge.event),
                    "type": edge.event.event_type,
                    "metrics": _metrics_of(session, "edge", edge.seq),
                }
                for edge in session.edges
            ],
        },
        "sizes": [
            {"graphID": row["node_id"], "size": row["size"], "location": row["location"]}
            for row in record.sizes().collect()  # one row per operation
        ],
        "duration": {"amount": record.nanos, "unit": "ns"},
        "metrics": [
            {"graphID": node, "metrics": _metrics_of(session, "node", node)} for node in measured
        ],
    }
    for name, content in (("inputs", inputs), ("outputs", outputs)):
        line = spark.createDataFrame([(json.dumps(content),)], "line string").coalesce(1)
        line.write.text(f"{request.output}/provenance/{name}.json")


def _metrics_of(session: ProvenanceSession, owner: str, owner_id: int) -> dict:
    """The metrics of one graph or operation; amounts and gauges are text."""
    found = []
    measured = (m[2:] for m in session.metrics if m[:2] == (owner, owner_id))
    for kind, name, value, unit, exact, text in measured:
        whole = value if exact is None else exact
        shown = {"amount": str(int(whole)), "unit": unit} if unit else text or str(value)
        found.append({"type": kind, "name": name, "value": shown})
    return {"type": "ObservationSet", "values": [found]}
