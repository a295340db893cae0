"""Which planned runs are still missing from a run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Repetitions listed at a time, so that no row holds all of them.
BLOCK = 10_000
RUN_KEY = ["dataset", "algorithm", "setup", "storage_format", "run_nr"]


def planned_runs(
    datasets: DataFrame,
    algorithms: list[str],
    setups: list[str],
    storage_formats: list[str],
    repetitions: int,
) -> DataFrame:
    """Every combination to run, from ``datasets (graph, algorithms)``.

    A dataset contributes the requested algorithms it supports; only
    CompleteProvenance is run in every format, the rest in text.  Run numbers go
    from 1 to ``repetitions``, which is at least 1.
    """

    def values(items: list[str]):
        return F.array(*[F.lit(item) for item in items])

    formats = F.when(
        F.col("setup") == "CompleteProvenance", values(storage_formats)
    ).otherwise(values(["TextFile()"]))
    return (
        datasets.select(
            F.col("graph").alias("dataset"),
            F.explode(F.array_intersect("algorithms", values(algorithms))).alias("algorithm"),
        )
        .withColumn("setup", F.explode(values(setups)))
        .withColumn("storage_format", F.explode(formats))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((repetitions - 1) // BLOCK))))
        .repartition("dataset", "algorithm", "setup", "storage_format", "block")
        .withColumn("first", F.col("block").cast("bigint") * BLOCK + 1)
        .withColumn("last", F.least(F.col("first") + BLOCK - 1, F.lit(repetitions)))
        .withColumn("run_nr", F.explode(F.sequence("first", "last")))
        .drop("block", "first", "last")
    )


def missing_runs(
    planned: DataFrame, runs: DataFrame, statuses: tuple[str, ...] = ("SUCCESS", "FAILURE")
) -> DataFrame:
    """Planned runs that no run in one of ``statuses`` covers.  Leave FAILURE out
    to have failed runs tried again."""
    done = runs.filter(F.col("status").isin(*statuses)).select(*RUN_KEY)
    return planned.join(done, RUN_KEY, "left_anti")
