"""Exact percentiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailgraph.workspace import Workspace

#: Distinct values that one window partition orders at most.
MOST_VALUES = 100_000
#: Pieces that a narrowing step cuts a piece into.
PIECES = 64


def percentiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    wanted: dict[str, float],
    most_values: int = MOST_VALUES,
) -> DataFrame:
    """One row per group of ``keys`` with a column per entry of ``wanted`` (name
    to a fraction between 0 and 1), linearly interpolated.  Null values are left
    out; a null key is a group like any other.

    Equal values are counted together first, in the only pass over ``rows``.
    While a piece of a group holds more than ``most_values`` distinct values, all
    pieces are cut at estimated quantiles, wherever the values lie, and only the
    smaller pieces that hold a wanted rank are kept.  Exact counts tell which
    those are, so an estimate decides how even the cut is and never the result.
    Each step makes the pieces some ``PIECES`` times smaller.
    """
    space = Workspace(rows.sparkSession, "percentiles")
    table = space.write("counts", _counts(rows, keys, value))
    sums = table.df.groupBy(*keys).agg(F.sum("n").alias("total"))
    totals = space.write("totals", sums).df
    step = 0
    while _largest(table.df, keys) > most_values:
        step += 1
        table = _narrow(space, step, table.df, totals, keys, wanted)
    return _pick(table.df, totals, keys, wanted)


def _counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, before, v, n)``: how often each value occurs, in one piece per
    group.  ``before`` counts the rows of the group below the piece."""
    return (
        rows.select(*keys, F.col(value).cast("double").alias("v"))
        .filter("v IS NOT NULL")
        .groupBy(*keys, "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.lit(0).cast("bigint"))
    )


def _largest(table: DataFrame, keys: list[str]) -> int:
    """Distinct values in the largest piece."""
    sizes = table.groupBy(*keys, "before").agg(F.count("v").alias("values"))
    return sizes.agg(F.max("values")).first()[0] or 0


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, null keys matching."""
    renamed = right.select(
        *[F.col(key).alias(f"__{key}") for key in keys],
        *[name for name in right.columns if name not in keys],
    )
    same = [left[key].eqNullSafe(F.col(f"__{key}")) for key in keys]
    return left.join(renamed, reduce(Column.__and__, same)).drop(*[f"__{key}" for key in keys])


def _narrow(space: Workspace, step: int, table: DataFrame, totals, keys, wanted):
    """The pieces cut into smaller ones, of which those with a wanted rank stay."""
    piece = [*keys, "before"]
    fractions = [k / PIECES for k in range(1, PIECES)]
    estimated = table.groupBy(*piece).agg(
        F.percentile_approx("v", fractions, PIECES * 32).alias("splits")
    )
    splits = space.write(f"splits-{step}", estimated).df
    bucket = F.size(F.filter("splits", lambda split: split < F.col("v")))
    placed = _matched(table, splits, piece).withColumn("bucket", bucket).drop("splits")

    running = Window.partitionBy(*piece).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sizes = placed.groupBy(*piece, "bucket").agg(F.sum("n").alias("size"))
    start = F.col("before") + F.sum("size").over(running) - F.col("size")
    chosen = (
        _matched(sizes.withColumn("start", start), totals, keys)
        .filter(F.size(_within(wanted, F.col("start"), F.col("size"))) > 0)
        .select(*piece, "bucket", "start")
    )
    kept = space.write(f"chosen-{step}", chosen).df
    narrowed = _matched(placed, kept, [*piece, "bucket"]).select(
        *keys, "v", "n", F.col("start").alias("before")
    )
    return space.write(f"counts-{step}", narrowed)


def _pick(table: DataFrame, totals: DataFrame, keys: list[str], wanted) -> DataFrame:
    """The wanted ranks, by ordering each piece."""
    inside = Window.partitionBy(*keys, "before").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    start = F.col("before") + F.sum("n").over(inside) - F.col("n")
    ranked = _matched(table.withColumn("start", start), totals, keys).select(
        *keys, "v", "total", F.explode(_within(wanted, F.col("start"), F.col("n"))).alias("p")
    )
    columns = []
    for name, fraction in wanted.items():
        low, high = (
            F.max(F.when((F.col("p.name") == name) & (F.col("p.side") == side), F.col("v")))
            for side in ("low", "high")
        )
        exact = F.lit(fraction) * (F.max("total") - 1)
        columns.append((low + (high - low) * (exact - F.floor(exact))).alias(name))
    return ranked.groupBy(*keys).agg(*columns)


def _within(wanted: dict[str, float], start: Column, size: Column) -> Column:
    """The wanted positions among ``size`` ranks from ``start``: the 0-based ranks
    on both sides of each fraction of a group of ``total`` rows."""
    positions = []
    for name, fraction in wanted.items():
        exact = F.lit(fraction) * (F.col("total") - 1)
        for side, rank in (("low", F.floor(exact)), ("high", F.ceil(exact))):
            positions.append(
                F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.alias("rank"))
            )
    return F.filter(
        F.array(*positions), lambda p: (p["rank"] >= start) & (p["rank"] < start + size)
    )
