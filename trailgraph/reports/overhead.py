"""What a setup costs compared with a baseline.

A ratio to zero is NULL.  A baseline is always brought down to one row per key before it is joined, so a
join never multiplies the runs of a key with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.functions.text import two_decimals
from trailgraph.reports.percentiles import percentiles
from trailgraph.reports.tables import PAIR


def baseline_means(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy(*PAIR).agg(F.avg("duration_s").alias("duration_baseline"))


def duration_overhead(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Runs with their duration over the mean baseline duration."""
    return runs.join(baseline_means(baseline), PAIR).withColumn(
        "overhead_duration", F.try_divide("duration_s", "duration_baseline")
    )


def size_overhead(runs: DataFrame, result_sizes: DataFrame) -> DataFrame:
    """Runs with their stored bytes over the bytes of the plain result
    ``(algorithm, dataset, size)``."""
    sizes = result_sizes.select(*PAIR, F.col("size").alias("size_baseline"))
    return runs.join(sizes, PAIR).withColumn(
        "overhead_size", F.try_divide("total_size", "size_baseline")
    )


def blowup(runs: DataFrame, graph_sizes: DataFrame) -> DataFrame:
    """Runs with their stored bytes over the bytes of the input graph
    ``(dataset, size)``."""
    sizes = graph_sizes.select("dataset", F.col("size").alias("graph_size"))
    return runs.join(sizes, "dataset").withColumn(
        "blowup", F.try_divide("total_size", "graph_size")
    )


def storage_overhead(snapshot_sizes: DataFrame, paired: DataFrame, outputs: DataFrame) -> DataFrame:
    """Snapshot bytes of a run with lineage over the bytes of the plain result."""
    stored = snapshot_sizes.groupBy("lineage_id").agg(F.sum("size").alias("snapshot_size"))
    first = paired.groupBy(*PAIR).agg(F.min_by("lineage_id", "run").alias("lineage_id"))
    return (
        first.join(stored, "lineage_id")
        .join(outputs, PAIR)
        .select(*PAIR, F.try_divide("snapshot_size", "without_lineage").alias("fraction"))
    )


def format_comparison(runs: DataFrame, text: str = "Text") -> DataFrame:
    """Runs of every format relative to the mean of the text runs of the same
    algorithm and dataset."""
    plain = (
        runs.filter(F.col("storage_format") == text)
        .groupBy(*PAIR)
        .agg(F.avg("duration_s").alias("text_duration"), F.avg("total_size").alias("text_size"))
    )
    return (
        runs.join(plain, PAIR)
        .withColumn("overhead_duration", F.try_divide("duration_s", "text_duration"))
        .withColumn("overhead_size", F.try_divide("total_size", "text_size"))
    )


def format_order(
    compared: DataFrame, metric: str = "overhead_duration", keys: list[str] | None = None
) -> DataFrame:
    """Formats by their mean overhead, lowest first, for each of ``keys``."""
    groups = keys or []
    means = compared.groupBy(*groups, "storage_format").agg(F.avg(metric).alias("mean"))
    return means.orderBy(*groups, "mean")


def replace_format(runs: DataFrame, replacement: DataFrame, label: str = "Text") -> DataFrame:
    """Runs with those of one format replaced by other runs under its label."""
    others = runs.filter(F.col("storage_format") != label)
    return others.unionByName(replacement.withColumn("storage_format", F.lit(label)))


def scenarios(runs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Runs with the scenario that ``names`` gives their setup, in one pass; other
    setups are left out."""
    scenario = F.lit(None).cast("string")
    for setup, name in names.items():
        scenario = F.when(F.col("setup") == setup, name).otherwise(scenario)
    return runs.withColumn("scenario", scenario).filter("scenario IS NOT NULL").select(
        "scenario", *PAIR, "duration_s", "total_size"
    )


def scenario_summary(combined: DataFrame, metric: str = "duration_s") -> DataFrame:
    """The numbers of a box plot of ``metric`` for each scenario."""
    quartiles = percentiles(
        combined, ["scenario"], metric, {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    ends = combined.groupBy("scenario").agg(
        F.count(metric).alias("runs"), F.min(metric).alias("min"), F.max(metric).alias("max")
    )
    return ends.join(quartiles, "scenario")


def paired_overhead(paired: DataFrame, per_iteration: bool = False) -> DataFrame:
    """Mean and population deviation, per algorithm and dataset, of the extra
    time in percent of runs with lineage against their twins without.

    A ratio up to 100 percent is kept as it is.
    """
    ratio: Column = F.try_divide("with_lineage", "without_lineage")
    if per_iteration:
        ratio = F.try_divide(ratio, F.col("iterations"))
    percent = ratio * 100
    extra = F.when(percent > 100, percent - 100).otherwise(percent)
    return (
        paired.withColumn("overhead", extra)
        .groupBy(*PAIR)
        .agg(F.avg("overhead").alias("mean"), F.stddev_pop("overhead").alias("std"))
    )


def describe_overhead(
    compared: DataFrame, metric: str = "overhead", keys: tuple[str, ...] = ("algorithm",)
) -> DataFrame:
    """min, median, max and sample deviation per algorithm, or other ``keys``, two
    decimals, the highest median first."""
    keys = list(keys)
    ends = compared.groupBy(*keys).agg(
        F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max")
    )
    median = percentiles(compared, keys, metric, {"median": 0.5})
    ordered = ends.join(median, keys).orderBy(F.col("median").desc())
    return ordered.select(
        *keys, *[two_decimals(c).alias(c) for c in ("std", "min", "median", "max")]
    )


def summed_baseline(
    baseline: DataFrame, runs: DataFrame, metric: str, keys: list[str] | None = None
) -> DataFrame:
    """Runs with ``metric`` over its sum in the baseline runs of the same key."""
    keys = keys or PAIR
    total = baseline.groupBy(*keys).agg(F.sum(metric).alias(f"baseline_{metric}"))
    return runs.join(total, keys).withColumn(
        "overhead", F.try_divide(metric, f"baseline_{metric}")
    )
