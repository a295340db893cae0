"""Run logs: the JSON records of experiments and the older size listings."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from trailgraph.functions.text import format_label, is_compressed
from trailgraph.workspace import Workspace, listed_paths, local_folder, located, write_partitions

# The fields of the run records; others are ignored.
INPUTS = (
    "config string, vertices string, edges string, parameters struct<"
    "experimentID: string, dataset: string, algorithm: string, runNr: bigint, "
    "outputDir: string, lineageDir: string, setup: string, "
    "tracingEnabled: boolean, storageEnabled: boolean, storageFormat: string, "
    "applicationId: string, numExecutors: bigint>"
)
TIME_METRIC = "struct<type: string, name: string, value: struct<amount: string, unit: string>>"
GAUGE_METRIC = "struct<type: string, name: string, value: string>"
OUTPUTS = (
    "stdout string, stderr string, results string, lineageDirectory string, graph struct<"
    "nodes: array<struct<id: bigint, location: string>>, edges: array<struct<source: bigint, "
    "target: bigint, relationship: string, type: string, metrics: struct<type: string, "
    f"values: array<array<{TIME_METRIC}>>>>>>, "
    "sizes array<struct<graphID: bigint, size: bigint, location: string>>, "
    "duration struct<amount: double, unit: string>, "
    "metrics array<struct<graphID: bigint, metrics: struct<type: string, "
    f"values: array<array<{GAUGE_METRIC}>>>>>"
)
# Fixed value: how the folder of an experiment is named.
EXPERIMENT = r"(experiment-[^/]+)"


def _records(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(f"{root}/experiment-*/provenance/{name}.json")
        .withColumn("experiment", F.regexp_extract(F.input_file_name(), EXPERIMENT, 1))
    )


def load_records(spark: SparkSession, root: str) -> DataFrame:
    """``(experiment, inputs, outputs)`` of the experiments that have both."""
    inputs = _records(spark, root, "inputs", INPUTS)
    outputs = _records(spark, root, "outputs", OUTPUTS)
    left = inputs.select("experiment", F.struct("config", "parameters").alias("inputs"))
    right = outputs.select(
        "experiment", F.struct("graph", "sizes", "duration", "metrics").alias("outputs")
    )
    return left.join(right, "experiment")


def load_runs(spark: SparkSession, root: str, datasets: DataFrame) -> DataFrame:
    """The ``runs`` table of all experiments under ``root``."""
    return normalised_runs(load_records(spark, root), datasets)


def normalised_runs(records: DataFrame, datasets: DataFrame) -> DataFrame:
    """One flat row per run: lower-case setup, short format label, total bytes
    stored, rounds, operations, and seconds."""
    parameters = "inputs.parameters"
    stored = F.col("outputs.sizes.size")
    edge_types = F.col("outputs.graph.edges.type")

    def edges_of(kind: str):
        return F.size(F.filter(edge_types, lambda t: t == kind))

    nothing = F.lit(0).cast("bigint")
    sizes = datasets.select(F.col("graph").alias("dataset"), "n_vertices")
    return (
        records.select(
            "experiment",
            F.lower(f"{parameters}.setup").alias("setup"),
            F.col(f"{parameters}.algorithm").alias("algorithm"),
            F.col(f"{parameters}.dataset").alias("dataset"),
            F.col(f"{parameters}.runNr").alias("run_nr"),
            format_label(f"{parameters}.storageFormat").alias("storage_format"),
            is_compressed(f"{parameters}.storageFormat").alias("compressed"),
            F.aggregate(stored, nothing, lambda total, size: total + size).alias("total_size"),
            F.col(f"{parameters}.numExecutors").alias("n_executors"),
            edges_of("pregelIteration").alias("iterations"),
            edges_of("operation").alias("n_operations"),
            (F.col("outputs.duration.amount") / 1e9).alias("duration_s"),
        )
        .join(sizes, "dataset", "left")
        .select(
            "experiment", "setup", "algorithm", "dataset", "run_nr", "storage_format",
            "compressed", "total_size", "n_executors", "n_vertices", "iterations",
            "n_operations", "duration_s",
        )
    )


def load_metrics(spark: SparkSession, root: str) -> DataFrame:
    """``(experiment, node_id, kind, name, value)`` rows of the recorded metrics;
    of a time, the value is its amount."""
    nested = load_records(spark, root).select(
        "experiment", F.explode("outputs.metrics").alias("node")
    )
    rows = nested.select(
        "experiment",
        F.col("node.graphID").alias("node_id"),
        F.explode(F.flatten("node.metrics.values")).alias("metric"),
    )
    kind = F.lower(F.regexp_extract("metric.type", r"([A-Za-z]+)\$?$", 1))
    return rows.select(
        "experiment",
        "node_id",
        kind.alias("kind"),
        F.col("metric.name").alias("name"),
        F.coalesce(F.get_json_object("metric.value", "$.amount"), "metric.value")
        .cast("double")
        .alias("value"),
    )


def _listing(spark: SparkSession, path: str) -> DataFrame:
    token = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .filter(F.trim("value") != "")
        .select(token[0].cast("bigint").alias("size"), F.element_at(token, -1).alias("path"))
    )


def load_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(lineage_id, iteration, size)`` of the snapshot files in a size listing."""
    pattern = r"([^/]+)/(\d+)\.v$"
    return (
        _listing(spark, path)
        .filter(F.col("path").rlike(pattern))
        .select(
            F.regexp_extract("path", pattern, 1).alias("lineage_id"),
            F.regexp_extract("path", pattern, 2).cast("int").alias("iteration"),
            "size",
        )
    )


def load_output_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(algorithm, dataset, with_lineage, without_lineage)`` bytes of result
    files named ``<algorithm>-<dataset>[-lineage].<extension>``."""
    stem = F.regexp_extract("path", r"([^/]+)$", 1)
    dataset = F.regexp_extract(stem, r"^[^-]*-([^.]*)", 1)
    rows = _listing(spark, path).select(
        F.regexp_extract(stem, r"^([^-]*)-", 1).alias("algorithm"),
        F.regexp_replace(dataset, "-lineage$", "").alias("dataset"),
        dataset.endswith("-lineage").alias("lineage"),
        "size",
    )
    return rows.groupBy("algorithm", "dataset").agg(
        F.max(F.when(F.col("lineage"), F.col("size"))).alias("with_lineage"),
        F.max(F.when(~F.col("lineage"), F.col("size"))).alias("without_lineage"),
    )


# The fields of the older run records.
PAIRED = (
    "algorithm string, graph string, metadata struct<lineageDirectory: string, "
    "duration: struct<duration: double, unit: string>, "
    "iterations: array<struct<idx: int, messageCount: bigint>>>"
)


_FOLDERS = ("experiment", "run", "lineage")
# How Spark names the folders of partitions.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def save_paired(records: DataFrame, root: str) -> None:
    """Write the tree that ``load_paired`` reads, a file per run and side, from
    ``records`` with the columns ``experiment, run, lineage`` and those of ``PAIRED``.

    On a file system of the machine the tasks make the files themselves, as Hadoop
    starts a process for each of them there and moves them one after another.
    """
    spark = records.sparkSession
    dealt = records.withColumn("lineage", F.col("lineage").cast("string")).repartition(
        write_partitions(spark), *_FOLDERS
    )
    place = local_folder(spark, root)
    if place is None:
        dealt.write.option("maxRecordsPerFile", 1).partitionBy(*_FOLDERS).json(root)
        return
    if os.path.exists(place):
        raise AnalysisException(f"[PATH_ALREADY_EXISTS] Path {root} already exists.")
    os.makedirs(place)
    record = F.to_json(F.struct(*[F.col(name) for name in records.columns if name not in _FOLDERS]))
    rows = dealt.select(*[F.col(name).cast("string") for name in _FOLDERS], record.alias("record"))
    write = _record_writer(place, str(uuid.uuid4()))
    rows.sortWithinPartitions(*_FOLDERS).mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def _record_writer(place: str, token: str) -> Callable[[Iterator], Iterator]:
    """What writes each record to a file in its folder, for tasks that may not have this package.

    The names do not depend on the attempt, and a file is renamed when whole: a
    task that is run again replaces it.
    """
    import pyarrow as pa

    folders, no_value, special = _FOLDERS, _NO_VALUE, _ESCAPED

    def escaped(value: str | None) -> str:
        return special.sub(lambda found: f"%{ord(found[0]):02X}", value) if value else no_value

    def write(batches: Iterator) -> Iterator:
        task = TaskContext.get()
        last, number = None, 0
        for batch in batches:
            *names, records = [column.to_pylist() for column in batch.columns]
            for *values, record in zip(*names, records):
                folder = os.path.join(place, *[f"{name}={escaped(value)}" for name, value in zip(folders, values)])
                number = number + 1 if folder == last else 0
                if folder != last:
                    os.makedirs(folder, exist_ok=True)
                last = folder
                name = f"part-{task.partitionId():05d}-{token}.c{number:03d}.json"
                mine = os.path.join(folder, f".{name}.{task.taskAttemptId()}")
                with open(mine, "w", encoding="utf-8", newline="\n") as file:
                    file.write(f"{record}\n")
                os.replace(mine, os.path.join(folder, name))
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    return write


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by as many tasks as write them, and not by one for each of
    up to 10,000 folders, which takes longer to start than to list.  What was found
    is not kept for a second listing, which there is not."""
    held = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(write_partitions(spark)),
        "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    }
    before = {key: spark.conf.get(key, None) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Folders of runs that are listed and read at once; the driver holds their files alone.
FOLDERS_PER_PASS = 20_000
_HIDDEN = re.compile(r"_(?!common_metadata|metadata)[^=]*|\..*|.*\._COPYING_")


def _passes(spark: SparkSession, root: str) -> Iterator[list[str]]:
    """What stands two levels below ``root``, so many at a time, whatever it is."""
    pattern, files = located(spark, root)

    def inside(folder: str) -> list[str]:
        found = listed_paths(spark, files.listStatus(located(spark, folder)[0]))
        return [path for path in found if path == folder or not _HIDDEN.fullmatch(path.rsplit("/", 1)[1])]

    waiting: list[str] = []
    tops = files.globStatus(pattern)
    for top in [] if tops is None else listed_paths(spark, tops):
        for folder in inside(top):
            waiting += inside(folder)
            while len(waiting) >= FOLDERS_PER_PASS:
                yield waiting[:FOLDERS_PER_PASS]
                waiting = waiting[FOLDERS_PER_PASS:]
    if waiting:
        yield waiting


def _json_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The documents below ``paths``, which are no patterns."""
    reader = (
        spark.read.schema(PAIRED)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
    )
    many = spark.sparkContext._jvm.org.apache.commons.lang3.StringUtils.split("\0".join(paths), "\0")
    with _few_listing_tasks(spark):
        return DataFrame(reader.option("__globPaths__", "false")._jreader.json(many), spark)


def load_paired(spark: SparkSession, root: str) -> DataFrame:
    """Each run with lineage next to its twin without, matched by path.

    The tree below ``root`` has a folder per experiment, run and side; what
    stands there is one JSON document, or a file of one written by Spark, whose
    folders are named ``experiment=...`` and so on.  The tree is listed and read
    once for both sides, so many runs at a time, each by many tasks.
    """
    run = r"(experiment[-=][^/]+/run[-=][^/]+)/lineage[-=]"
    inside = r"/experiment[-=][^/]*/run[-=][^/]*/lineage[-=](true|false)/[^/]+$"
    path = F.col("_metadata.file_path")

    def read(files: DataFrame) -> DataFrame:
        return files.filter(path.rlike(inside)).select(
            "algorithm", "graph", "metadata",
            F.regexp_extract(path, run, 1).alias("run"), F.regexp_extract(path, inside, 1).alias("side"),
        )

    place = f"{Workspace(spark, 'paired').path}/read"
    rows = None
    for paths in _passes(spark, root):
        rows = read(_json_files(spark, paths))
        rows.coalesce(write_partitions(spark)).write.mode("append").parquet(place)
    if rows is None:  # nothing is there, which is an error if there is no such folder
        rows = read(spark.read.schema(PAIRED).json(root))
        rows.write.parquet(place)
    found = spark.read.schema(rows.schema).parquet(place)

    duration = F.col("metadata.duration.duration")
    with_lineage = found.filter("side = 'true'").select(
        "run",
        "algorithm",
        F.col("graph").alias("dataset"),
        duration.alias("with_lineage"),
        F.col("metadata.iterations").alias("rounds"),
        F.col("metadata.lineageDirectory").alias("lineage_id"),
    )
    without = found.filter("side = 'false'").select("run", duration.alias("without_lineage"))
    return with_lineage.join(without, "run").select(
        "run", "algorithm", "dataset", "with_lineage", "without_lineage",
        F.coalesce(F.size("rounds"), F.lit(0)).alias("iterations"), "rounds", "lineage_id",
    )
