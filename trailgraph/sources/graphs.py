"""Graphs and expected results from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailgraph.graph import PropertyGraph
from trailgraph.plans.prepared import symmetric
from trailgraph.sources.descriptors import load_datasets

# What the token "infinity" stands for in each value type.
INFINITY = {"bigint": 9223372036854775807, "double": float("inf")}


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    line = F.trim("value")
    return (
        spark.read.text(path)
        .filter(line != "")
        .select(F.split(line, r"\s+").alias("token"))
    )


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src dst [weight]`` lines; the weight is 0.0 where there is none."""
    token = F.col("token")
    weight = F.when(F.size(token) == 3, token[2].cast("double")).otherwise(F.lit(0.0))
    return _tokens(spark, path).select(
        token[0].cast("bigint").alias("src"),
        token[1].cast("bigint").alias("dst"),
        weight.alias("attr"),
    )


def load_vertices(spark: SparkSession, path: str) -> DataFrame:
    """One vertex per line; the first token is its id."""
    return _tokens(spark, path).select(F.col("token")[0].cast("bigint").alias("id"))


def load_graph(spark: SparkSession, prefix: str, directed: bool | None = True) -> PropertyGraph:
    """The graph of ``<prefix>.v`` and ``<prefix>.e``.

    Edges are taken as written, in one direction.  With ``directed=False`` every
    edge is added in the other direction as well; None looks the choice up in
    ``<prefix>.properties``.
    """
    if directed is None:
        found = load_datasets(spark, f"{prefix}.properties").first()
        if found is None or found["directed"] is None:
            raise ValueError(f"{prefix}.properties does not say whether the graph is directed")
        directed = found["directed"]
    edges = load_edges(spark, f"{prefix}.e")
    if not directed:
        edges = symmetric(edges)
    return PropertyGraph.from_edges(edges, load_vertices(spark, f"{prefix}.v"))


def load_expected(spark: SparkSession, path: str, value_type: str = "bigint") -> DataFrame:
    """Expected results: ``id value`` lines, where the value may be ``infinity``."""
    token = F.col("token")
    infinite = F.lit(INFINITY[value_type]).cast(value_type)
    value = F.when(F.lower(token[1]) == "infinity", infinite).otherwise(token[1].cast(value_type))
    return _tokens(spark, path).select(token[0].cast("bigint").alias("id"), value.alias("value"))
