"""Report functions and text functions on small tables."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from trailgraph.functions import text
from trailgraph.reports import coverage, filters, overhead, percentiles, tables


def one(spark, value, function, kind="double"):
    frame = spark.createDataFrame([(value,)], f"x {kind}")
    return frame.select(function("x")).first()[0]


@pytest.mark.parametrize(
    "size, shown",
    [(0.0, "0 B"), (1023.0, "1023 B"), (1024.0, "1 KB"), (1024.0**2 - 1, "1023 KB"),
     (3.9 * 1024**3, "3 GB"), (1024.0**8, "1 YB"), (5000 * 1024.0**8, "5000 YB")],
)
def test_human_size(spark, size, shown):
    assert one(spark, size, text.human_size) == shown


@pytest.mark.parametrize(
    "nanos, shown",
    [(999_999_999, ""), (1_000_000_000, "1 second"), (61_000_000_000, "1 minute 1 second"),
     (7_325_999_999_999, "2 hours 2 minutes 5 seconds"),
     (176_400_000_000_000, "2 days 1 hour"), (8_639_999_999_999_999, "99 days 23 hours 59 minutes 59 seconds")],
)
def test_human_duration(spark, nanos, shown):
    assert one(spark, nanos, text.human_duration, "long") == shown


@pytest.mark.parametrize(
    "seconds, shown", [(5.9, "00:05"), (65.0, "01:05"), (3600.0, "1h 0m 0s"), (7325.0, "2h 2m 5s")]
)
def test_clock(spark, seconds, shown):
    assert one(spark, seconds, text.clock) == shown


@pytest.mark.parametrize(
    "value, label",
    [("TextFile()", "Text"), ("TextFile(true)", "Text-C"), ("CSVFile(false)", "CSV"),
     ("JSONFormat(true)", "JSON-C"), ("ParquetFile()", "Parquet-C"), ("ObjectFile()", "Object")],
)
def test_format_label(spark, value, label):
    assert one(spark, value, text.format_label, "string") == label


def test_names(spark):
    assert one(spark, " a, #b ,, c,", text.name_list, "string") == ["a", "c"]
    assert one(spark, "PR", text.algorithm_name, "string") == "PageRank"
    assert one(spark, "sort", text.algorithm_name, "string") is None
    assert one(spark, "datagen-7_5-fb", text.escaped, "string") == "datagen-7\\_5-fb"


@pytest.mark.parametrize("most", [100_000, 50])
@pytest.mark.parametrize("shape", ["spread", "copies", "single", "outlier"])
def test_percentiles_are_exact(spark, shape, most):
    rng = random.Random(5)
    groups = {
        "spread": [rng.gauss(0, 100) for _ in range(501)],
        "copies": [7.0] * 300 + [rng.random() for _ in range(200)],
        "single": [3.5],
        "outlier": [rng.random() for _ in range(400)] + [1e12],
    }
    rows = [("x", v) for v in groups[shape]] + [("y", float(i)) for i in range(4)]
    frame = spark.createDataFrame(rows, "g string, v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    found = {
        r["g"]: r for r in percentiles.percentiles(frame, ["g"], "v", wanted, most).collect()
    }
    for group in ("x", "y"):
        ordered = sorted(v for g, v in rows if g == group)
        for name, fraction in wanted.items():
            exact = fraction * (len(ordered) - 1)
            low = int(exact)
            high = min(low + 1, len(ordered) - 1)
            value = ordered[low] + (ordered[high] - ordered[low]) * (exact - low)
            assert found[group][name] == pytest.approx(value), (group, name)


RUNS = [
    ("BFS", "a_1", "Text", 10.0, 2000), ("BFS", "a_1", "Text", 20.0, 4000),
    ("BFS", "a_1", "CSV-C", 30.0, 1000), ("WCC", "b", "Text", 5.0, 0),
]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(
        RUNS, "algorithm string, dataset string, storage_format string, "
        "duration_s double, total_size long"
    )


def test_duration_and_size_tables(runs):
    durations = tables.duration_table(runs.filter("algorithm = 'BFS'")).first()
    assert tuple(durations) == ("BFS", "a\\_1", "10.00", "20.00", "30.00", "10.00")
    sizes = tables.size_table(runs).collect()
    assert [tuple(r) for r in sizes] == [
        ("BFS", "a\\_1", "1000 B", "2 KB", "3 KB"), ("WCC", "b", "0 B", "0 B", "0 B")
    ]


def test_overheads(spark, runs):
    base = spark.createDataFrame(
        [("BFS", "a_1", 5.0), ("BFS", "a_1", 15.0)],
        "algorithm string, dataset string, duration_s double",
    )
    found = overhead.duration_overhead(runs, base)
    assert sorted(r["overhead_duration"] for r in found.collect()) == [1.0, 2.0, 3.0]
    summed = overhead.summed_baseline(base, runs, "duration_s")
    assert sorted(r["overhead"] for r in summed.collect()) == [0.5, 1.0, 1.5]
    sizes = spark.createDataFrame(
        [("BFS", "a_1", 1000), ("WCC", "b", 0)], "algorithm string, dataset string, size long"
    )
    ratios = overhead.size_overhead(runs, sizes).collect()
    assert sorted(r["overhead_size"] or -1 for r in ratios) == [-1, 1.0, 2.0, 4.0]
    graph_sizes = spark.createDataFrame([("a_1", 500)], "dataset string, size long")
    assert overhead.blowup(runs, graph_sizes).agg(F.max("blowup")).first()[0] == 8.0
    described = overhead.describe_overhead(
        filters.within_bounds(found, "overhead_duration"), "overhead_duration"
    )
    assert tuple(described.first()) == ("BFS", None, "1.00", "1.00", "1.00")


def test_filters(runs):
    assert filters.without_pair(runs, "WCC", "b").count() == 3
    assert filters.without_pair(runs, "BFS", "b").count() == 4
    assert filters.without_dataset(runs, "a_1").count() == 1
    assert filters.storing(runs).count() == 3
    assert filters.not_too_long(runs, longest=10).count() == 2
    assert filters.large_enough(runs, smallest=1000).count() == 2


def test_percentile_pieces_stay_small(spark, monkeypatch):
    """An outlier 1e12 times as large does not put the rest into one piece."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 1000 == 7, None).otherwise("x").alias("g"),
        F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 200_000).alias("v"),
    )
    ordered = []
    pick = percentiles._pick

    def spy(table, *rest):
        ordered.append(percentiles._largest(table, ["g"]))
        return pick(table, *rest)

    monkeypatch.setattr(percentiles, "_pick", spy)
    found = percentiles.percentiles(rows, ["g"], "v", {"m": 0.5, "top": 1.0}, 1000).collect()
    assert max(ordered) <= 1000
    values = {row["g"]: row for row in found}
    assert values["x"]["top"] == 1e12
    assert values["x"]["m"] == pytest.approx(0.5, abs=1e-3)
    assert values[None]["top"] == pytest.approx(199_007 / 200_000)


def test_percentiles_of_nothing(spark):
    rows = spark.createDataFrame([("x", None)], "g string, v double")
    assert percentiles.percentiles(rows, ["g"], "v", {"m": 0.5}).collect() == []


def test_formats_and_scenarios(runs):
    compared = overhead.format_comparison(runs)
    assert compared.count() == 4
    order = [r["storage_format"] for r in overhead.format_order(compared).collect()]
    assert order == ["Text", "CSV-C"]
    replaced = overhead.replace_format(runs, runs.filter("storage_format = 'CSV-C'"))
    assert sorted(r["storage_format"] for r in replaced.collect()) == ["CSV-C", "Text"]
    summary = overhead.scenario_summary(overhead.scenarios(runs.withColumn("setup", F.lit("s1")), {"s1": "one", "s2": "two"}))
    row = summary.first()
    assert (row["scenario"], row["runs"], row["median"]) == ("one", 4, 15.0)


def test_paired_overhead(spark):
    rows = [("pr", "d", 3.0, 2.0, 2), ("pr", "d", 1.0, 2.0, 1)]
    paired = spark.createDataFrame(
        rows,
        "algorithm string, dataset string, with_lineage double, without_lineage double, "
        "iterations int",
    )
    row = overhead.paired_overhead(paired).first()
    assert (row["mean"], row["std"]) == (50.0, 0.0)
    row = overhead.paired_overhead(paired, per_iteration=True).first()
    assert (row["mean"], row["std"]) == (62.5, 12.5)
    row = tables.iterations_per_dataset(paired).first()
    assert (row["mean"], row["std"]) == (1.5, statistics.pstdev([1, 2]))


def test_coverage(spark):
    datasets = spark.createDataFrame(
        [("d", ["BFS", "LCC"]), ("e", ["WCC"])], "graph string, algorithms array<string>"
    )
    planned = coverage.planned_runs(
        datasets, ["BFS", "WCC"], ["Baseline", "CompleteProvenance"],
        ["TextFile()", "ORCFile()"], 2,
    )
    assert planned.count() == 2 * (1 + 2) * 2
    runs = spark.createDataFrame(
        [("d", "BFS", "Baseline", "TextFile()", 1, "SUCCESS"),
         ("d", "BFS", "Baseline", "TextFile()", 2, "FAILURE")],
        "dataset string, algorithm string, setup string, storage_format string, run_nr long, "
        "status string",
    )
    assert coverage.missing_runs(planned, runs).count() == 10
    assert coverage.missing_runs(planned, runs, ("SUCCESS",)).count() == 11
