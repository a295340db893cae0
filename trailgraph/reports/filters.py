"""Runs that a report leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Bounds used by the reports.
LONGEST_SECONDS = 1300
SMALLEST_BYTES = 2**20


def without_pair(runs: DataFrame, algorithm: str, dataset: str) -> DataFrame:
    """Without the runs of one algorithm on one dataset."""
    return runs.filter((F.col("algorithm") != algorithm) | (F.col("dataset") != dataset))


def without_dataset(runs: DataFrame, dataset: str) -> DataFrame:
    return runs.filter(F.col("dataset") != dataset)


def storing(runs: DataFrame, metric: str = "total_size") -> DataFrame:
    """Only the runs that stored something."""
    return runs.filter(F.col(metric) > 0)


def not_too_long(
    runs: DataFrame, metric: str = "duration_s", longest: float = LONGEST_SECONDS
) -> DataFrame:
    return runs.filter(~(F.col(metric) > longest))


def large_enough(
    runs: DataFrame, metric: str = "total_size", smallest: int = SMALLEST_BYTES
) -> DataFrame:
    return runs.filter(F.col(metric) > smallest)


def within_bounds(
    runs: DataFrame, metric: str = "overhead", low: float = 0.6, high: float = 2.0
) -> DataFrame:
    """Without the runs whose overhead is an outlier."""
    return runs.filter((F.col(metric) > low) & (F.col(metric) < high))
