"""Projections and filters over vertices, edges and triplets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.operators.triplets import BOTH_ENDS, as_column, triplets


def map_vertices(vertices: DataFrame, expression: Column | str) -> DataFrame:
    return vertices.select("id", as_column(expression).alias("attr"))


def map_edges(edges: DataFrame, expression: Column | str) -> DataFrame:
    return edges.select("src", "dst", as_column(expression).alias("attr"))


def map_triplets(
    vertices: DataFrame,
    edges: DataFrame,
    expression: Column | str,
    ends: Iterable[str] = BOTH_ENDS,
) -> DataFrame:
    """New edge attribute from ``src, dst, attr`` and the attributes of the
    ``ends`` the expression reads."""
    return map_edges(triplets(vertices, edges, ends), expression)


def remove_self_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def subgraph(
    vertices: DataFrame,
    edges: DataFrame,
    vertex_predicate: Column | str | None = None,
    edge_predicate: Column | str | None = None,
    ends: Iterable[str] = BOTH_ENDS,
) -> tuple[DataFrame, DataFrame]:
    """Vertices that pass, and the edges that pass with both ends kept.

    ``ends`` names the endpoint attributes the edge predicate reads.
    """
    columns = edges.columns
    kept = vertices
    if vertex_predicate is not None:
        kept = vertices.filter(as_column(vertex_predicate))
    passing = edges
    if edge_predicate is not None:
        passing = triplets(vertices, edges, ends).filter(as_column(edge_predicate))
        passing = passing.select(*columns)
    if vertex_predicate is not None:
        for end in BOTH_ENDS:
            ids = kept.select(F.col("id").alias("kept_id"))
            passing = passing.join(ids, F.col(end) == F.col("kept_id"), "left_semi")
    return kept, passing
