"""Dataset descriptors: ``graph.<name>.<key> = value`` property files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailgraph.functions.text import algorithm_name, name_list

# Descriptor keys with the column and type each becomes.
KEYS = {
    "vertex-file": ("vertex_file", "string"),
    "edge-file": ("edge_file", "string"),
    "meta.vertices": ("n_vertices", "bigint"),
    "meta.edges": ("n_edges", "bigint"),
    "directed": ("directed", "boolean"),
    "algorithms": ("algorithms", "string"),
    "edge-properties.names": ("edge_property", "string"),
    "edge-properties.types": ("edge_property_type", "string"),
    "bfs.source-vertex": ("bfs_source", "bigint"),
    "sssp.source-vertex": ("sssp_source", "bigint"),
    "sssp.weight-property": ("sssp_weight", "string"),
    "pr.damping-factor": ("pr_damping", "double"),
    "pr.num-iterations": ("pr_iterations", "int"),
    "cdlp.max-iterations": ("cdlp_iterations", "int"),
}


def load_datasets(spark: SparkSession, path: str) -> DataFrame:
    """All descriptors under ``path`` (a file or a glob), one row per graph."""
    pattern = r"^\s*graph\.([^.=\s]+)\.([^=\s]+)\s*=\s*(.*?)\s*$"
    entries = (
        spark.read.text(path)
        .filter(F.col("value").rlike(pattern))
        .select(
            F.regexp_extract("value", pattern, 1).alias("graph"),
            F.regexp_extract("value", pattern, 2).alias("key"),
            F.regexp_extract("value", pattern, 3).alias("text"),
        )
    )
    table = entries.groupBy("graph").pivot("key", list(KEYS)).agg(F.first("text"))
    columns = [
        F.col(f"`{key}`").cast(value_type).alias(name) for key, (name, value_type) in KEYS.items()
    ]
    return table.select("graph", *columns).withColumn(
        "algorithms", F.transform(name_list("algorithms"), algorithm_name)
    )
