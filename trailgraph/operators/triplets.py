"""The triplet view: edges with the attributes of their endpoints."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

BOTH_ENDS = ("src", "dst")


def as_column(expression: Column | str) -> Column:
    return F.expr(expression) if isinstance(expression, str) else expression


def triplets(
    vertices: DataFrame, edges: DataFrame, ends: Iterable[str] = BOTH_ENDS
) -> DataFrame:
    """Edges plus ``src_attr`` and/or ``dst_attr``.

    Only the ends named are joined.  Both are plain inner equi-joins, so AQE
    picks the strategy, and splits the partitions of a hub unless what follows
    groups by the end joined last.
    """
    view = edges
    for end in ends:
        attribute = vertices.select(
            F.col("id").alias(f"{end}_id"), F.col("attr").alias(f"{end}_attr")
        )
        view = view.join(attribute, F.col(end) == F.col(f"{end}_id")).drop(f"{end}_id")
    return view
