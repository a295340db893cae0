"""Statistics of runs per algorithm and dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailgraph.functions.text import escaped, human_size, two_decimals
from trailgraph.reports.percentiles import percentiles

PAIR = ["algorithm", "dataset"]


def statistics(runs: DataFrame, metric: str, keys: list[str] | None = None) -> DataFrame:
    """min, mean, max and sample standard deviation of ``metric`` per group."""
    return runs.groupBy(*(keys or PAIR)).agg(
        F.min(metric).alias("min"),
        F.avg(metric).alias("mean"),
        F.max(metric).alias("max"),
        F.stddev_samp(metric).alias("std"),
    )


def duration_table(
    runs: DataFrame, metric: str = "duration_s", keys: list[str] | None = None
) -> DataFrame:
    """The printed duration table: two decimals, names escaped, shortest first."""
    others = [key for key in keys or PAIR if key != "dataset"]
    ordered = statistics(runs, metric, keys).orderBy(*others, "mean")
    return ordered.select(
        *others,
        escaped("dataset").alias("dataset"),
        *[two_decimals(c).alias(c) for c in ("min", "mean", "max", "std")],
    )


def size_table(
    runs: DataFrame, metric: str = "total_size", keys: list[str] | None = None
) -> DataFrame:
    """The printed size table, in readable units."""
    others = [key for key in keys or PAIR if key != "dataset"]
    ordered = statistics(runs, metric, keys).orderBy(*others, "mean")
    return ordered.select(
        *others,
        escaped("dataset").alias("dataset"),
        *[human_size(c).alias(c) for c in ("min", "mean", "max")],
    )


def dataset_sizes(sizes: DataFrame) -> DataFrame:
    """Bytes of the vertices and edges of each dataset, from ``(dataset, kind, size)``."""
    return (
        sizes.filter(F.col("kind").isin("vertices", "edges"))
        .groupBy("dataset")
        .agg(F.sum("size").alias("size"))
        .withColumn("pretty_size", human_size("size"))
    )


def group_summary(runs: DataFrame) -> DataFrame:
    """Bytes, rounds, distinct durations and median duration per setup and format."""
    keys = ["setup", "storage_format"]
    sums = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("total_size").alias("total_size"),
        F.sum("iterations").alias("iterations"),
        F.count_if(F.col("total_size") > 0).alias("stored_runs"),
        F.count_distinct("duration_s").alias("distinct_durations"),
    )
    median = percentiles(runs, keys, "duration_s", {"median_duration": 0.5})
    return sums.join(median, keys)


def iterations_per_dataset(runs: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the rounds."""
    return runs.groupBy(*PAIR).agg(
        F.avg("iterations").alias("mean"), F.stddev_pop("iterations").alias("std")
    )


def messages_per_round(paired: DataFrame) -> DataFrame:
    """``(algorithm, dataset, round, messages)`` of runs with recorded rounds;
    rounds count from 1."""
    return paired.select(
        "run", "algorithm", "dataset", F.explode("rounds").alias("r")
    ).select(
        "run", "algorithm", "dataset",
        (F.col("r.idx") + 1).alias("round"),
        F.col("r.messageCount").alias("messages"),
    )
