"""Joins of the vertices of a graph with other keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.operators.triplets import as_column


def _with_new(vertices: DataFrame, table: DataFrame, how: str) -> DataFrame:
    other = table.select(
        F.col("id").alias("other_id"),
        *[F.col(c).alias(f"new_{c}" if c != "attr" else "new") for c in table.columns if c != "id"],
    )
    return vertices.join(other, F.col("id") == F.col("other_id"), how)


def join_vertices(vertices: DataFrame, table: DataFrame, expression: Column | str) -> DataFrame:
    """Vertices with a row ``(id, attr)`` in ``table`` get ``expression``, built
    from ``id``, ``attr`` and ``new``; the rest keep their attribute."""
    joined = _with_new(vertices, table, "left")
    value = F.when(F.col("other_id").isNotNull(), as_column(expression)).otherwise(F.col("attr"))
    return joined.select("id", value.alias("attr"))


def outer_join_vertices(
    vertices: DataFrame, table: DataFrame, expression: Column | str
) -> DataFrame:
    """Every vertex gets ``expression``; ``new`` is NULL where ``table`` has no row."""
    joined = _with_new(vertices, table, "left")
    return joined.select("id", as_column(expression).alias("attr"))


def inner_join_vertices(
    vertices: DataFrame, table: DataFrame, expression: Column | str = "attr"
) -> DataFrame:
    """Only the vertices that have a row in ``table``."""
    joined = _with_new(vertices, table, "inner")
    return joined.select("id", as_column(expression).alias("attr"))


def vertices_minus(vertices: DataFrame, other: DataFrame) -> DataFrame:
    """Vertices without a row in ``other``."""
    return vertices.join(other.select("id"), "id", "left_anti")


def restrict_vertices(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """Vertices whose id is in ``ids``, as they are."""
    return vertices.join(ids.select("id"), "id", "left_semi")


def verify_result(actual: DataFrame, expected: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Rows ``(id, actual, expected)`` on which two results ``(id, value)``
    differ; none means they agree.

    An id on one side only differs.  Whole numbers and infinities must be
    equal, other doubles within ``tolerance``.
    """
    left = actual.select("id", F.col("value").alias("actual"), F.lit(True).alias("in_actual"))
    right = expected.select(
        "id", F.col("value").alias("expected"), F.lit(True).alias("in_expected")
    )
    same = F.col("actual").eqNullSafe(F.col("expected"))
    if dict(actual.dtypes)["value"] in ("double", "float"):
        infinite = F.lit(float("inf"))
        finite = (F.abs("actual") < infinite) & (F.abs("expected") < infinite)
        close = finite & (F.abs(F.col("actual") - F.col("expected")) <= tolerance)
        same = same | F.coalesce(close, F.lit(False))
    in_both = F.col("in_actual").isNotNull() & F.col("in_expected").isNotNull()
    return (
        left.join(right, "id", "full_outer")
        .filter(~(in_both & same))
        .select("id", "actual", "expected")
    )
