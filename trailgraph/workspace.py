"""Working tables kept between the rounds of an iterative job.

Every round of an iterative algorithm ends in a table written to shared
storage.  That cuts the lineage, gives the next plan real file sizes to plan
with, and survives the loss of any executor.  The folder is the one the cluster
names in ``spark.checkpoint.dir``; a temporary one is only made for a local
session that names none.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder for working tables."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(
            "set spark.checkpoint.dir to a folder that all executors share"
        )
    if context.applicationId not in _LOCAL_ROOTS:
        root = tempfile.mkdtemp(prefix="trailgraph-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _LOCAL_ROOTS[context.applicationId] = root
    return _LOCAL_ROOTS[context.applicationId]


def session_root(spark: SparkSession) -> str:
    """The folder of this application below ``work_root``."""
    return f"{work_root(spark)}/trailgraph-{spark.sparkContext.applicationId}"


def clear_session(spark: SparkSession) -> None:
    """Delete all working tables of this application, results included."""
    delete_path(spark, session_root(spark))


@dataclass(frozen=True)
class Table:
    """A written working table, with what was observed while writing it."""

    df: DataFrame
    path: str
    observed: dict = field(default_factory=dict)


class Workspace:
    """One job's folder of working tables."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{session_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._named: dict[str, str] = {}

    def write(
        self, name: str, df: DataFrame, *, keep: list[str] | None = None, **metrics: Column
    ) -> Table:
        """Write ``df``, or its columns ``keep``, and read it back; ``metrics`` are
        aggregates over its rows, taken by the same job that writes them."""
        path = f"{self.path}/{name}"
        kept = df if keep is None else df.select(*keep)
        if not metrics:
            kept.write.parquet(path)
            return Table(self.read(path, kept), path)
        observation = Observation()
        columns = [metric.alias(key) for key, metric in metrics.items()]
        observed = df.observe(observation, *columns)
        (observed if keep is None else observed.select(*keep)).write.parquet(path)
        return Table(self.read(path, kept), path, dict(observation.get))

    def write_bucketed(
        self, name: str, df: DataFrame, key: str, buckets: int, *, placed: bool = False, **metrics: Column
    ) -> Table:
        """Write ``df`` as a table with one file a bucket of ``key``, sorted by it.

        A join or aggregation on ``key`` reads it without moving it, and a filter
        on a few keys reads their buckets alone.  ``placed`` says that the tasks of
        ``df`` have one bucket each already; it is written as it stands then, in no
        order.  ``metrics`` are as in ``write``.
        """
        limit = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        buckets = max(1, min(buckets, limit))
        path, table = f"{self.path}/{name}", f"trailgraph_{uuid.uuid4().hex}"
        rows, observation = df if placed else df.repartition(buckets, key), Observation()
        if metrics:
            rows = rows.observe(observation, *[metric.alias(key) for key, metric in metrics.items()])
        writer = rows.write.bucketBy(buckets, key)
        (writer if placed else writer.sortBy(key)).option("path", path).saveAsTable(table)
        self._named[path] = table
        return Table(self.spark.table(table), path, dict(observation.get) if metrics else {})

    def plain(self, table: Table) -> Table:
        """A bucketed table as files alone, out of the catalog."""
        df = self.read(table.path, table.df)
        self._forget(table.path)
        return Table(df, table.path, table.observed)

    def is_bucketed(self, table: Table) -> bool:
        return table.path in self._named

    def read(self, path: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(path)

    def drop(self, table: Table | None) -> None:
        """Delete a superseded table of this workspace."""
        if table is not None and table.path.startswith(self.path + "/"):
            self._forget(table.path)
            delete_path(self.spark, table.path)

    def _forget(self, path: str) -> None:
        if path in self._named:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._named.pop(path)}")

    def clear(self) -> None:
        for path in list(self._named):
            self._forget(path)
        delete_path(self.spark, self.path)


def write_partitions(spark: SparkSession) -> int:
    """Partitions for a table of many small files.  Their number has to be given:
    the rows are so few bytes that they would be merged into one task, which then
    makes all files one after another."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def located(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path of ``path``, and the file system that it is in."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system knows it, or None where it is in another store."""
    hadoop_path, files = located(spark, path)
    uri = files.makeQualified(hadoop_path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def listed_paths(spark: SparkSession, statuses) -> list[str]:
    """The paths of a Hadoop listing, in order.  They come as one text, as a call for
    each takes longer than to list them."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses)
    joined = spark.sparkContext._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(paths).mkString("\0")
    return sorted(joined.split("\0")) if joined else []


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names of what stands in a folder, in order; none if there is no such folder."""
    hadoop_path, files = located(spark, path)
    found = listed_paths(spark, files.listStatus(hadoop_path)) if files.exists(hadoop_path) else []
    return [each.rsplit("/", 1)[1] for each in found]


def rename_path(spark: SparkSession, path: str, new: str) -> None:
    hadoop_path, files = located(spark, path)
    if not files.rename(hadoop_path, located(spark, new)[0]):
        raise OSError(f"{path} could not be renamed to {new}")


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop_path, files = located(spark, path)
    files.delete(hadoop_path, True)
